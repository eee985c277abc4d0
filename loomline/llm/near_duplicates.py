"""Near-duplicate passages with small edits.

1. One pass over the texts makes of each passage its words (lower case, no accents, no marks), the 32-bit hashes of its
   sequences of three words in order, and a key of the whole word sequence. Words are hashed in whole batches of texts.
2. Copies of one word sequence count as one text.
3. ``hashes`` min-hashes of the sequences give each text a fingerprint of ``SYMBOLS`` symbols of three bits, so that the Hamming distance
   of two fingerprints falls with overlap, and its band keys: ``bands`` of ``rows`` min-hashes each, and ``long_bands`` of
   one min-hash each over runs of eight words, of which small edits leave some whole. Keys are spread over buckets of bounded size; a key that is
   frequent in a task is salted over many buckets, with some of its texts in the unsalted bucket too.
4. Pivot table: the Hamming distances of a fingerprint to ``pivots`` reference fingerprints are computed once per text that has
   company under a key. A pair whose greatest coordinate difference exceeds the radius can't lie within the radius (triangle
   inequality) and is discarded; then the fingerprints themselves are compared. Under a key of up to ``window``
   texts all meet; beyond, each text first meets the first ``window`` until four are alike.
5. Survivors are verified on the exact sequences. A second round, in slices, compares under each larger key all
   texts that verified links haven't put into one component; only pairs already in one group are left out.
6. Links become groups by connected components.

Nulls: rows with a null id or text, and passages under ``least_words`` words, are in no group. A repeated
id is taken once. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import broadcast_if_small, mix, word_hashes
from loomline.llm.components import components
from loomline.session import cut_lineage, discard, written

SYMBOLS = 128
LONG = 6  # sequences of three words that make a run of eight words
WORD = re.compile(r"[^\W_]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FNV = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    """Lower case words without accents, marks and line ends. ``sequences`` hashes the same words without making a list of them."""
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t)
        t = "".join(c for c in t if not unicodedata.combining(c))
    return WORD.findall(t)


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a batch of texts: (words of each text, key of each word sequence, hashes of all sequences of three words in order, text of each)."""
    plain = [t if t.isascii() else unicodedata.normalize("NFKD", t) for t in map(str.lower, texts)]
    counts, h = word_hashes(plain)
    if not len(h):
        return counts, np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        text = np.repeat(np.arange(len(texts)), counts)
        offset = np.cumsum(counts) - counts
        order = (np.arange(len(h)) - offset[text]).astype(np.uint64)
        key = np.zeros(len(texts), dtype=np.uint64)
        some = counts > 0
        key[some] = np.add.reduceat(mix(h + order * _FNV), offset[some])
        g = (mix(h[:-2] * np.uint64(3) + h[1:-1] * _FNV + h[2:] * _PRIME) >> np.uint64(32)).astype(np.uint32)
    whole = text[:-2] == text[2:]
    return counts, mix(key).view(np.int64), g[whole], text[:-2][whole]


def _batches(pdf: pd.DataFrame, size: np.ndarray, most: int) -> Iterator[pd.DataFrame]:
    """Parts of a frame of about ``most`` in size each."""
    part = np.cumsum(size) // most
    for at in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(part)) + 1):
        if len(at):
            yield pdf.iloc[at]


def _sketch(least_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for pdf in _batches(whole, whole["text"].str.len().to_numpy(np.int64), 1_000_000):
                counts, key, grams, text = sequences(pdf["text"].tolist())
                cut = np.searchsorted(text, np.arange(len(pdf) + 1))
                keep = np.flatnonzero(counts >= least_words)
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[keep], "text_key": key[keep], "grams": [grams[cut[k] : cut[k + 1]].tobytes() for k in keep]})

    return run


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint32)


def minima(grams: list[np.ndarray], hashes: int, long_bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Min-hashes of the sequences of each text, and of its runs of ``LONG`` sequences."""
    seeds = mix(np.arange(1, hashes + long_bands + 1, dtype=np.uint64) + np.uint64(0xABCDEF12345)) | np.uint64(1)
    size = np.array([len(g) for g in grams])
    start = np.cumsum(size) - size
    g = np.concatenate(grams)
    with np.errstate(over="ignore"):
        run = np.zeros(len(g), dtype=np.uint64)
        for k in range(LONG):  # runs that leave their text hash only what is left of it
            run[: len(g) - k] = run[: len(g) - k] * _FNV + g[k:]
        over = np.arange(len(g)) + LONG > np.repeat(start + size, size)
        run = np.where(over & (np.arange(len(g)) != np.repeat(start, size)), np.uint64(0xFFFFFFFF), mix(run) >> np.uint64(32)).astype(np.uint32)
        short, long_ = np.empty((len(grams), hashes), dtype=np.uint32), np.empty((len(grams), long_bands), dtype=np.uint32)
        for k in range(hashes):
            short[:, k] = np.minimum.reduceat(_spread(g, seeds[k]), start)
        for k in range(long_bands):
            x = _spread(run, seeds[hashes + k])
            x[run == 0xFFFFFFFF] = 0xFFFFFFFF
            long_[:, k] = np.minimum.reduceat(x, start)
    return short, long_


def _spread(g: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = g * np.uint32(seed & np.uint64(0xFFFFFFFF)) + np.uint32(seed >> np.uint64(32))
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


def fingerprints(mins: np.ndarray) -> np.ndarray:
    """Three bits of each of ``SYMBOLS`` min-hashes, as six words of 64 bits: two for each bit."""
    place = np.arange(64, dtype=np.uint64)
    x = mix(mins[:, :SYMBOLS].astype(np.uint64) + np.uint64(1))
    bits = [(x >> np.uint64(s)) & np.uint64(1) for s in (40, 41, 42)]
    return np.stack([(b[:, at : at + 64] << place).sum(axis=1, dtype=np.uint64) for b in bits for at in (0, 64)], axis=1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols in which fingerprints differ (last axis: the six words)."""
    x = a ^ b
    return np.bitwise_count(x[..., 0] | x[..., 2] | x[..., 4]).astype(np.int16) + np.bitwise_count(x[..., 1] | x[..., 3] | x[..., 5])


def reference_fingerprints(pivots: int) -> np.ndarray:
    """Reference fingerprints, the same in each task."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 6 * pivots + 1, dtype=np.uint64) * _PRIME).reshape(pivots, 6)


def band_keys(mins: np.ndarray, long_mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of a text, multiples of 4 below 2^48 (1 marks a salted key, 2 a text that stands for salted ones in the unsalted bucket). Each band takes ``rows`` of the min-hashes, chosen once and for all."""
    rnd = np.random.default_rng(1)
    chosen = np.array([rnd.choice(mins.shape[1], rows, replace=False) for _ in range(bands)])
    with np.errstate(over="ignore"):
        keys = np.zeros((len(mins), bands), dtype=np.uint64)
        for r in range(rows):
            keys = mix(keys + mins[:, chosen[:, r]] + np.uint64(r + 1))
        keys = np.concatenate([keys, mix(long_mins.astype(np.uint64) + (np.uint64(1) << np.uint64(40)))], axis=1)
        keys = mix(keys + np.arange(keys.shape[1], dtype=np.uint64) * _PRIME)
    return keys & np.uint64((1 << 48) - 4)


def _six(keys: np.ndarray) -> bytes:
    """Keys have 48 bits."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _bands(bands: int, rows: int, hashes: int, long_bands: int, buckets: int, hot: int, salts: int = 64, part: int = 20_000):
    """Rows (bucket, keys, texts, text_keys, fps): the keys of a part of the texts that fall into a bucket, the number of the text of
    each, and key and fingerprint of those texts, packed. A key of more than ``hot`` texts of a part is salted."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for pdf in frames:
            for small in _batches(pdf, pdf["grams"].str.len().to_numpy(np.int64), 2_000_000):
                mins, long_mins = minima([unpack(g) for g in small["grams"]], hashes, long_bands)
                held.append([small["text_key"].to_numpy(np.int64), fingerprints(mins), band_keys(mins, long_mins, bands, rows)])
                if sum(len(h[0]) for h in held) >= part:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held = []
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for text_key, fp, keys in parts(frames):
            _, once = np.unique(text_key, return_index=True)
            text_key, fp, keys = text_key[once], fp[once], keys[once]
            text, key = np.repeat(np.arange(len(keys)), keys.shape[1]), keys.ravel()
            short = (key >> np.uint64(28)).astype(np.int64)
            maybe = np.flatnonzero(np.bincount(short, minlength=1 << 20)[short] > hot)
            _, inverse, often = np.unique(key[maybe], return_inverse=True, return_counts=True)
            many = maybe[often[inverse] > hot]
            salt = np.zeros(len(key), dtype=np.uint64)
            if len(many):
                salt[many] = np.uint64(1) + mix(text_key[text[many]].view(np.uint64)) % np.uint64(salts)
                by = many[np.argsort(key[many], kind="stable")]
                begin = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
                rank = np.arange(len(by)) - np.repeat(begin, np.diff(np.r_[begin, len(by)]))
                both = by[rank <= hot]  # these stand for the salted ones in the unsalted bucket
                key[many] |= np.uint64(1)
                text, key, salt = np.r_[text, text[both]], np.r_[key, key[both] ^ np.uint64(3)], np.r_[salt, np.zeros(len(both), dtype=np.uint64)]
            with np.errstate(over="ignore"):
                bucket = (mix((key & ~np.uint64(3)) + salt * _PRIME) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets <= len(order) else None
            found = np.unique(bucket) if cut is None else np.flatnonzero(np.diff(cut))
            out = []
            for b in found:
                at = order[cut[b] : cut[b + 1]] if cut is not None else order[np.searchsorted(bucket[order], b) : np.searchsorted(bucket[order], b, "right")]
                own, number = np.unique(text[at], return_inverse=True)
                out.append((int(b), _six(key[at]), number.astype(np.uint32 if len(own) > 1 << 16 else np.uint16).tobytes(), text_key[own].tobytes(), fp[own].tobytes()))
            yield pd.DataFrame(out, columns=["bucket", "keys", "texts", "text_keys", "fps"])

    return run


def _alike(fa: np.ndarray, fb: np.ndarray, ta: np.ndarray, tb: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs survive the pivot table and then the distance of the fingerprints."""
    ok = (np.abs(ta - tb) <= radius).all(axis=1)
    ok[ok] = distance(fa[ok], fb[ok]) <= radius
    return ok


def _meet(window: int, radius: int, pivots: int, enough: int = 4):
    """Candidate pairs (a, b) of a bucket, and the rows (a, band, fp) of its large or salted keys, which go on to the second round."""
    refs = reference_fingerprints(pivots)
    kinds = {"a": "int64", "b": "Int64", "band": "Int64", "fp": "object"}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(x) // 8 for x in pdf["text_keys"]])
        shift = np.cumsum(sizes) - sizes
        key = np.concatenate([_eight(x) for x in pdf["keys"]])
        text = np.concatenate([np.frombuffer(x, np.uint32 if n > 1 << 16 else np.uint16).astype(np.int64) + s for x, n, s in zip(pdf["texts"], sizes, shift, strict=True)])
        text_key = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["text_keys"]])
        fp = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 6) for x in pdf["fps"]])
        stands = key & np.uint64(2) > 0
        key = key & ~np.uint64(2)
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        by = by[np.r_[False, same] | np.r_[same, False]]  # texts that have company
        by = by[np.lexsort((text_key[text[by]], key[by]))]
        key, text, stands = key[by], text[by], stands[by]
        tk = text_key[text]
        new = np.r_[True, (key[1:] != key[:-1]) | (tk[1:] != tk[:-1])][: len(key)]  # copies of a text lie side by side
        key, text, tk, stands = key[new], text[new], tk[new], stands[new]
        n = len(key)
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:n])
        length = np.repeat(np.diff(np.r_[head, n]), np.diff(np.r_[head, n]))
        place = np.arange(n) - np.repeat(head, np.diff(np.r_[head, n]))
        salted = (key & np.uint64(1) > 0) | np.repeat(np.logical_or.reduceat(stands, head) if n else stands, np.diff(np.r_[head, n]))
        used, number = np.unique(text, return_inverse=True)
        f = fp[used]
        table = distance(f[:, None, :], refs[None, :, :])
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = _alike(f[number[i]], f[number[j]], table[number[i]], table[number[j]], radius)
            out.append((np.minimum(tk[i[ok]], tk[j[ok]]), np.maximum(tk[i[ok]], tk[j[ok]])))
            return ok

        active = np.arange(n)
        for d in range(1, window):
            active = active[place[active] + d < np.minimum(length[active], window)]
            if not len(active):
                break
            for at in range(0, len(active), 200_000):
                pairs(active[at : at + 200_000], active[at : at + 200_000] + d)
        far = np.flatnonzero(place >= window)
        met = np.zeros(len(far), dtype=np.int64)
        for k in range(window if len(far) else 0):
            open_ = np.flatnonzero(met < enough)
            if not len(open_):
                break
            met[open_] += pairs(far[open_] - place[far[open_]] + k, far[open_])
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        res = [pd.DataFrame({"a": a, "b": b}).drop_duplicates().assign(band=None, fp=None)]
        large = np.flatnonzero((length > window) | salted)
        if len(large):
            res.append(pd.DataFrame({"a": tk[large], "b": None, "band": (key[large] & ~np.uint64(3)).view(np.int64), "fp": [x.tobytes() for x in f[number[large]]]}))
        return pd.concat([r.astype(kinds) for r in res])

    return run


def _verify(share: float):
    """Exact share of common sequences, repeats counted, against the longer passage."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ok = np.zeros(len(pdf), dtype=bool)
            for i, (x, y) in enumerate(zip(pdf["ga"], pdf["gb"], strict=True)):
                x, y = unpack(x), unpack(y)
                if min(len(x), len(y)) < share * max(len(x), len(y)):
                    continue
                ux, cx = np.unique(x, return_counts=True)
                uy, cy = np.unique(y, return_counts=True)
                _, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
                ok[i] = np.minimum(cx[ix], cy[iy]).sum() >= share * max(len(x), len(y))
            yield pdf.loc[ok, ["a", "b"]]

    return run


def second_round(large: DataFrame, comp: DataFrame, radius: int, slice_rows: int) -> DataFrame:
    """(a, b): alike pairs of the rows (band, a, fp) of large keys, but those of one component (node, component).

    Texts of the commonest component of a key needn't meet each other, so one side holds the others only. Both sides are cut into
    slices of about ``slice_rows``, each pair of slices is a group of its own, and no pair of rows is emitted unless alike.
    """
    tagged = large.dropDuplicates(["band", "a"]).join(comp.select(F.col("node").alias("a"), "component"), "a", "left")
    rows = written(tagged.select("band", "a", "fp", F.coalesce("component", "a").alias("tag")), "large")
    common = rows.groupBy("band", "tag").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("tag", F.struct("n", "tag")).alias("common"), F.sum("n").alias("n"), F.max("n").alias("most")).filter("most < n")
    slices = [F.greatest(F.lit(1), F.ceil(n / slice_rows)).cast("int") for n in (F.col("n") - F.col("most"), F.col("n"))]
    rows = rows.join(common.select("band", "common", slices[0].alias("ln"), slices[1].alias("rn")), "band")

    def cut(df: DataFrame, own: str, other: str, count: str, others: str) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("a"), F.col(count)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).select("band", "ls", "rs", "a", "fp", "tag")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty((0, 2), dtype=np.int64)]
        right = right.rename(columns=lambda c: c.rstrip("_"))
        if len(left) and len(right):
            la, ra, lt, rt = (d[c].to_numpy(np.int64) for c in ("a", "tag") for d in (left, right))
            lf, rf = (np.frombuffer(b"".join(d["fp"]), np.uint64).reshape(-1, 6) for d in (left, right))
            for at in range(0, len(la), 256):
                part = slice(at, at + 256)
                i, j = np.nonzero((distance(lf[part, None], rf[None]) <= radius) & (lt[part, None] != rt[None, :]))
                out.append(np.stack([np.minimum(la[part][i], ra[j]), np.maximum(la[part][i], ra[j])], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"])

    left, right = cut(rows.filter("tag != common"), "ls", "rs", "ln", "rn"), cut(rows, "rs", "ls", "rn", "ln")
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])  # both come of the same rows
    return left.groupBy("band", "ls", "rs").cogroup(right.groupBy("band_", "ls_", "rs_")).applyInPandas(meet, "a bigint, b bigint").distinct()


def _joined(links: DataFrame, more: DataFrame, comp: DataFrame) -> DataFrame:
    """Components after more links: those links, taken between components, are a small graph of their own."""
    name = comp.select("node", "component")
    of = lambda c: more.select(c).distinct().join(name.withColumnRenamed("node", c), c, "left").select(c, F.coalesce("component", c).alias(f"{c}_in"))
    over = components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("a_in").alias("a"), F.col("b_in").alias("b")))
    ends = more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct()
    nodes = name.unionByName(ends.join(name, "node", "left_anti").select("node", F.col("node").alias("component")))
    over = over.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return nodes.join(over, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def groups(
    passages: DataFrame,
    id_col: str = "id",
    text_col: str = "ray_peat_response",
    share: float = 0.5,
    least_words: int = 20,
    bands: int = 32,
    rows: int = 3,
    hashes: int = 128,
    long_bands: int = 24,
    pivots: int = 8,
    radius: int = 86,
    window: int = 1024,
    hot: int = 200,
    slice_rows: int = 4096,
    bucket_keys: int = 3_000_000,
) -> DataFrame:
    """(id, text_key, group_key, links): a row for each passage of at least ``least_words`` words.

    ``text_key`` names the class of passages with the same words, ``group_key`` the group of linked classes,
    ``links`` counts the classes found to be linked to it directly. Production parameters are the defaults.
    """
    spark = passages.sparkSession
    source = passages.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    sketch = written(source.mapInPandas(_sketch(least_words), "id string, text_key bigint, grams binary"), "sketch")
    members = sketch.select("id", "text_key").distinct()
    buckets = max(spark.sparkContext.defaultParallelism, -(-sketch.count() * (bands + long_bands) // bucket_keys))
    banded = sketch.select("text_key", "grams").mapInPandas(_bands(bands, rows, hashes, long_bands, buckets, hot), "bucket bigint, keys binary, texts binary, text_keys binary, fps binary")
    met = written(banded.groupBy("bucket").applyInPandas(_meet(window, radius, pivots), "a bigint, b bigint, band bigint, fp binary"), "met")
    pairs = met.filter("band IS NULL").select("a", "b").distinct()
    grams = sketch.select("text_key", "grams")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        ends = pairs.select(F.col("a").alias("text_key")).unionByName(pairs.select(F.col("b").alias("text_key"))).distinct()
        own = grams.join(broadcast_if_small(ends), "text_key", "left_semi").dropDuplicates(["text_key"])
        both = pairs.join(own.select(F.col("text_key").alias("a"), F.col("grams").alias("ga")), "a").join(own.select(F.col("text_key").alias("b"), F.col("grams").alias("gb")), "b")
        links = cut_lineage(both.mapInPandas(_verify(share), "a bigint, b bigint"))
        discard(pairs)
        return links

    links = verified(pairs)
    comp = cut_lineage(components(links))
    more = verified(second_round(met.filter("band IS NOT NULL").select("band", "a", "fp"), comp, radius, slice_rows).join(links, ["a", "b"], "left_anti"))
    discard(met)
    comp = _joined(links, more, comp)
    links = links.unionByName(more)
    degree = links.select(F.col("a").alias("text_key")).unionByName(links.select(F.col("b").alias("text_key"))).groupBy("text_key").agg(F.count("*").alias("links"))
    known = comp.withColumnRenamed("node", "text_key").join(degree, "text_key", "left")
    return members.join(known, "text_key", "left").select("id", "text_key", F.coalesce("component", "text_key").alias("group_key"), F.coalesce("links", F.lit(0)).alias("links"))


def pairs_in_groups(grouped: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of the same group; groups of one id drop out before the join."""
    more = grouped.groupBy("group_key").agg(F.count("*").alias("n")).filter("n > 1").select("group_key")
    kept = grouped.join(more, "group_key", "left_semi").select("group_key", "id")
    return kept.select("group_key", F.col("id").alias("id_a")).join(kept.select("group_key", F.col("id").alias("id_b")), "group_key").filter("id_a < id_b").select("id_a", "id_b").distinct()
