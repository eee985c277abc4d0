"""Training-data operators against brute force and on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from loomline.llm import common, leakage, mixing, near_duplicates, qa_defects, splitting, token_budget, toxicity, transcripts
from loomline.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def text_of(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


# Problem 1


@pytest.mark.parametrize(
    "question,answer,defect",
    [
        ("Is salt good?", None, "empty"),
        ("Is salt good?", " ​\t", "empty"),
        ("Is salt good?", "[1][2]", "empty"),
        ("Is salt good?", "**Answer:**", "empty"),
        ("Is salt good?", "n/a", "empty"),
        ("Is salt good?", "Yes.", None),
        ("How much salt?", "About 5 grams", None),
        (None, "Salt helps some people during the day.", None),
        (None, None, "empty"),
        ("Is salt good for the thyroid gland?", "I'm sorry, but I can't give advice on salt. Could you rephrase?", "refusal"),
        ("Is salt good for the thyroid gland?", "Unfortunately many people cannot digest this well. Salt raises the pulse of most people.", None),
        ("Is salt good for the thyroid gland?", "Is salt good for the thyroid gland?", "echo"),
        ("Is salt good for the thyroid gland?", "You want to know about this: is salt good for the thyroid gland", "echo"),
        ("Is salt good for the thyroid gland?", "You want to know about this: Is salt good for the thyroid gland?\n\nIt is, and it lowers the stress hormones of people who sleep badly at night.", None),
        ("Is salt good for the thyroid?", "It was the salt that first showed how the pulse of the morning", "truncated"),
        ("Is salt good for the thyroid?", "It helps. \"The salt raises", "truncated"),
        ("Is salt good for the thyroid?", "It helps.\n\n1. Salt is good.\n2.", "truncated"),
        ("Is salt good for the thyroid?", "It helps.\n\n- Salt is good\n- Milk as well", None),
        ("Is salt good for the thyroid?", "Three things matter here. First, the salt is low.", "truncated"),
        ("Is salt good for the thyroid?", "Three things matter here. First, salt. Second, milk. Third, light.", None),
        ("Is salt good for the thyroid when it is cold?", "Das Salz ist gut für die Drüse und der Puls wird am Morgen nicht so hoch.", "wrong_language"),
        ("Is salt good for the thyroid? Reply in German, please.", "Das Salz ist gut für die Drüse und der Puls wird am Morgen nicht so hoch.", None),
    ],
)
def test_defects(question, answer, defect):
    import pandas as pd

    got = next(qa_defects.judge(iter([pd.DataFrame({"id": [1], "question": [question], "answer": [answer]})])))
    assert got["defect"][0] == defect


def test_defects_table(spark):
    schema = "id long, question string, answer string, confidence string, defect int"
    rows = [(1, "q", None, "HIGH", 3), (1, "q", None, "HIGH", 3), (None, "q", None, None, 1), (2, "q", "word " * 200_000 + "end.", None, 1), (3, "", "", None, 0)]
    assert sorted(tuple(r) for r in qa_defects.defects(spark.createDataFrame(rows, schema)).collect()) == [(1, "empty"), (3, "empty")]
    assert qa_defects.defects(spark.createDataFrame([], schema)).count() == 0


def test_suffix_automaton_runs():
    rnd = random.Random(0)
    for _ in range(200):
        q = [rnd.choice("abc") for _ in range(rnd.randint(0, 8))]
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 8))]
        want = []
        for i in range(len(a)):
            n = 0
            while n <= i and any(q[k : k + n + 1] == a[i - n : i + 1] for k in range(len(q) - n)):
                n += 1
            want.append(n)
        assert qa_defects.SuffixAutomaton(q).runs(a) == want


# Problem 2


def brute_groups(rows, share=0.5, least=20):
    docs = {}
    for i, t in rows:
        w = near_duplicates.words_of(t)
        if i is not None and t is not None and len(w) >= least:
            docs[i] = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    from collections import Counter

    ids = sorted(docs)
    head = {i: i for i in ids}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sum((Counter(docs[a]) & Counter(docs[b])).values()) >= share * max(len(docs[a]), len(docs[b])):
                head[find(a)] = find(b)
    return {(a, b) for a in ids for b in ids if a < b and find(a) == find(b)}


def varied(rnd, base, edits):
    w = base.split()
    for _ in range(edits):
        k = rnd.randrange(len(w))
        w[k] = rnd.choice(WORDS)
    return " ".join(w)


@pytest.mark.parametrize("window", [32, 3])
def test_groups_against_brute_force(spark, window):
    rnd = random.Random(7)
    rows = []
    hot = text_of(rnd, 60)
    for i in range(120):  # a third of all rows is one text with small edits
        rows.append((f"h{i}", varied(rnd, hot, rnd.randint(0, 4))))
    for i in range(60):
        base = text_of(rnd, rnd.randint(25, 80))
        rows += [(f"a{i}", base), (f"b{i}", varied(rnd, base, 3).upper() + "!")]
    rows += [(f"s{i}", text_of(rnd, 60)) for i in range(60)] + [("short", "too short"), ("null", None), (None, hot), ("h0", rows[0][1])]
    df = spark.createDataFrame(rows, "id string, ray_peat_response string").withColumn("band", F.lit(1)).withColumn("text", F.lit("x")).withColumn("grams", F.lit(None).cast("string"))
    grouped = near_duplicates.groups(df, window=window)
    got = {tuple(r) for r in near_duplicates.pairs_in_groups(grouped).collect()}
    want = brute_groups(rows)
    assert not got - want and len(got & want) >= 0.99 * len(want)


def test_groups_of_nothing(spark):
    e = spark.createDataFrame([], "id string, ray_peat_response string")
    assert near_duplicates.pairs_in_groups(near_duplicates.groups(e)).count() == 0


def test_sequences_hash_the_words_of_each_text():
    """Equal words, equal key and hashes, whatever the accents, marks and neighbours in the batch; other words, others."""
    import numpy as np

    rnd = random.Random(3)
    texts = ["", "  ", "Café Ünï 12 ß_x", "cafe uni 12 ß x", "a b", "a b c", "x\ny z\x00w", "\ud83d\ude00 ok ﬁ", "é" * 5, "東京 都 𝒜bc"] + [text_of(rnd, rnd.randint(1, 60)) for _ in range(40)]
    texts += [t.upper() + " !" for t in texts]
    counts, key, grams, text = near_duplicates.sequences(texts)
    words = [near_duplicates.words_of(t) for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    for i, a in enumerate(words):
        own = grams[text == i]
        assert len(own) == max(0, len(a) - 2)
        alone = near_duplicates.sequences([texts[i]])
        assert alone[1][0] == key[i] and (alone[2] == own).all()
        for j, b in enumerate(words):
            assert (key[i] == key[j]) == (a == b)
    sets = {}
    for i, w in enumerate(words):
        for k, g in enumerate(grams[text == i]):
            assert sets.setdefault(int(g), tuple(w[k : k + 3])) == tuple(w[k : k + 3])
    assert near_duplicates.sequences([])[0].tolist() == [] or np.size(near_duplicates.sequences([])[0]) <= 1


def shared(a, b):
    from collections import Counter

    a, b = ([tuple(w[k : k + 3]) for k in range(len(w) - 2)] for w in (a, b))
    return sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b))


def test_recall_near_the_threshold(spark):
    """Made pairs whose share lies just at or above a level, by scattered single words or by replaced blocks: at least 0.9 of each kind are linked."""
    rnd = random.Random(50)
    rows, kinds = [], [(level, size) for level in (0.5, 0.55, 0.6, 0.7) for size in (1, 8)]
    for level, size in kinds:
        made = 0
        while made < 150:
            a = text_of(rnd, rnd.randint(60, 160)).split()
            b = list(a)
            while shared(a, b) > level + 0.02:
                k = rnd.randrange(len(b))
                b[k : k + size] = text_of(rnd, size).split()
            if shared(a, b) >= level:
                rows += [(f"{level}-{size}-{made}{c}", " ".join(w)) for c, w in (("a", a), ("b", b))]
                made += 1
    got = {r.id: r.group_key for r in near_duplicates.groups(spark.createDataFrame(rows, "id string, ray_peat_response string")).collect()}
    recall = {k: sum(got[f"{k[0]}-{k[1]}-{i}a"] == got[f"{k[0]}-{k[1]}-{i}b"] for i in range(150)) / 150 for k in kinds}
    print(recall)
    assert min(recall.values()) >= 0.9


def test_salted_keys_lose_no_pair(spark):
    """A third of all rows under the same keys, salted and in many buckets, still comes out as one group."""
    rnd = random.Random(6)
    hot = text_of(rnd, 60)
    rows = [(f"h{i}", varied(rnd, hot, rnd.randint(0, 3))) for i in range(400)] + [(f"s{i}", text_of(rnd, 60)) for i in range(800)]
    df = spark.createDataFrame(rows, "id string, ray_peat_response string").repartition(3)
    got = {r.id: r.group_key for r in near_duplicates.groups(df, window=6, hot=6, bucket_keys=3000, slice_rows=100).collect()}
    assert len({got[f"h{i}"] for i in range(400)}) == 1 and len(set(got.values())) == 801


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 100), (5, 5), (None, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_template_bands_lose_no_true_pair(spark):
    """Texts that share a template just under the threshold are fingerprint-alike to the heads of their bands, but only verified links tie."""
    rnd = random.Random(5)
    template = text_of(rnd, 45)
    own = [text_of(rnd, 55).split() for _ in range(150)]
    rows = []
    for i, w in enumerate(own):
        rows.append((f"a{i}", f"{template} {' '.join(w)}"))
        rows.append((f"b{i}", f"{template} {' '.join(w[:35])} {text_of(rnd, 20)}"))
    df = spark.createDataFrame(rows, "id string, ray_peat_response string")
    got = {r.id: r.group_key for r in near_duplicates.groups(df, bands=8, rows=1, long_bands=0, radius=118, window=4, slice_rows=50).collect()}
    assert sum(got[f"a{i}"] == got[f"b{i}"] for i in range(len(own))) == len(own)


# Problem 3


def test_token_budget_counts_rows_without_id(spark):
    schema = "id string, source_file string, source_type string, primary_topic string, ray_peat_response string"
    rows = [(None, None, None, None, "salt"), (None, None, None, None, "salt"), (None, None, None, None, "salt and milk"), ("1", None, None, None, "salt"), ("1", None, None, None, "salt")]
    files = spark.createDataFrame([], "source_file string, source_type string")
    m = token_budget.measured(spark.createDataFrame(rows, schema), files)
    total = token_budget.budget(m).filter("source_type = 'all' AND lang = 'all' AND topic = 'all'").first()
    assert (total.passages, total.total_tokens) == (4, sum(token_budget.count_tokens(["salt", "salt", "salt and milk", "salt"], token_budget.TOKENIZER)))


def test_token_budget(spark):
    schema = "id string, source_file string, source_type string, primary_topic string, ray_peat_response string, tokens int, lang string, text string"
    rows = [
        ("1", "01_Audio_Transcripts\\x.txt", "article", "Salt ", "The salt is in the water and it is good.", 3, "x", None),
        ("1", "01_Audio_Transcripts\\x.txt", "article", "Salt ", "The salt is in the water and it is good.", 3, "x", None),
        ("2", "f/y.txt", "", None, None, None, None, None),
        ("3", "f/y.txt", "e-mail", None, "", 0, None, None),
        ("4", None, None, None, "word " * 50_000, 0, None, None),
    ]
    files = spark.createDataFrame([("f/y.txt", "News-Letter"), (None, None)], "source_file string, source_type string")
    m = {r.id: r for r in token_budget.measured(spark.createDataFrame(rows, schema), files).collect()}
    assert (m["1"].source_type, m["1"].lang, m["1"].topic) == ("transcript", "en", "salt") and m["1"].tokens == 11
    assert (m["2"].source_type, m["2"].lang, m["2"].tokens) == ("newsletter", "unknown", 0)
    assert m["3"].source_type == "email" and m["4"].tokens > 49_000
    total = token_budget.budget(token_budget.measured(spark.createDataFrame(rows, schema), files)).filter("source_type = 'all' AND lang = 'all' AND topic = 'all'").first()
    assert (total.passages, total.total_tokens) == (4, sum(r.tokens for r in m.values()))
    empty = token_budget.budget(token_budget.measured(spark.createDataFrame([], schema), files)).collect()
    assert empty == []


def test_tokens_round_trip():
    enc = token_budget.tokenizer(token_budget.TOKENIZER)
    for t in ("Ça va? 12 grams — <b>now</b>", "", "ñ" * 50, " \n\t x"):
        assert enc.decode(enc.encode_ordinary(t)) == t


# Problem 4


def check_split(text, limit, overlap):
    got = splitting.split(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (_, b, _), (c, d, _) in zip(got, got[1:], strict=False):
        assert max(0, b - overlap) <= c <= b < d
    assert all(0 < b - a <= limit for a, b, _ in got) or not text
    import re

    longest = max(map(len, re.split(r"\s", text)))
    assert any(k == "forced_break" for *_, k in got) == (longest > limit and len(text) > limit)


def test_split_properties():
    rnd = random.Random(3)
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(1, 60)):
            parts.append("".join(rnd.choice("abcé") for _ in range(rnd.choice([1, 3, 7, 30, 95, 99, 100, 101, 130]))))
            parts.append(rnd.choice([" ", ". ", "\n", "\n\n", ", ", " ", "  "]))
        check_split("".join(parts), 100, rnd.choice([0, 10, 30]))


def test_an_edit_moves_only_near_cuts():
    rnd = random.Random(9)
    text = " ".join(text_of(rnd, rnd.randint(4, 12)) + "." for _ in range(300))
    a = splitting.split(text, 400, 0)
    b = splitting.split("Some new words at the head. " + text, 400, 0)
    ends_a, ends_b = {text[e - 30 : e] for _, e, _ in a}, {("Some new words at the head. " + text)[e - 30 : e] for _, e, _ in b}
    assert len(ends_a & ends_b) >= 0.8 * len(ends_a)


def test_pieces_table(spark):
    results = spark.createDataFrame([("1", "a " * 600, 5), ("1", "a " * 600, 5), ("2", "b" * 1500, 5), ("3", None, 5), (None, "c " * 900, 5), ("4", "", 1)], "id string, context string, piece int")
    docs = spark.createDataFrame([(7, "x" * 3 + "d " * 4000), (8, None)], "doc_id long, text string")
    chunks = spark.createDataFrame([(7, 1, 3, 8003), (7, 1, 3, 8003), (7, 2, 0, 10), (8, 1, 0, 9000), (9, 1, 0, 9000), (None, 1, 0, 9000)], "doc_id long, chunk_id int, start_pos int, end_pos int")
    items = splitting.oversized(results, chunks, docs)
    p = splitting.pieces(items, True)
    assert {(r.item_id, r.forced) for r in splitting.forced_items(p).collect()} == {("1", 0), ("2", 1), ("7:1", 0)}
    for item, text in (("1", "a " * 600), ("7:1", "d " * 4000)):
        got = sorted((r for r in p.collect() if r.item_id == item), key=lambda r: r.piece_no)
        joined = got[0].piece
        for q in got[1:]:
            joined = joined[: q.start_pos] + q.piece
        assert joined == text and [q.piece_no for q in got] == list(range(len(got)))
    assert splitting.pieces(splitting.oversized(results.limit(0), chunks.limit(0), docs.limit(0))).count() == 0


# Problem 5

PEOPLE = [("Mirel Oskander", "host"), ("Sunniva Threlk", "guest"), ("Quenby Stroud-Halle", "caller"), (None, "host")]


@pytest.mark.parametrize(
    "text,want",
    [
        (None, []),
        ("No labels here. Note: it is salt.", []),
        ("HOST: Salt is good.\nGUEST: Um, uh...\nhost: More salt.", [(1, "host")]),
        ("**Mirel Oskander:** Salt is good. **Dr. Threlk:** It is not.", [(1, "host"), (2, "guest")]),
        ("[00:10] <Oskader> Salt.\n\n[00:05] <S.T.> Milk is first.", [(1, "guest"), (2, "host")]),
        ("[00:10] Host: Salt.\nGuest: Milk, no time here.", [(1, "host"), (2, "guest")]),
        ("SPEAKER_01: Salt.\nSPEAKER_00: Milk.\nspeaker1: Light.", [(1, "speaker 1"), (2, "speaker 0"), (3, "speaker 1")]),
        ("Caller (line 2) [00:01:00]: Salt and milk\nmore of it\nAnimatrice [00:02:00] - Du sel.", [(1, "caller"), (2, "host")]),
        ("Hörerin: Das Salz.\nExperte: [Musik]\nModerador: La sal.", [(1, "caller"), (2, "host")]),
        ("00:01:10,500 - Q: Why salt?\n00:01:12,100 - A: [laughter] Because of the pulse.", [(1, "host"), (2, "guest")]),
    ],
)
def test_turns(text, want):
    names = transcripts.Names([p for p in PEOPLE if p[0]])
    assert [(n, s) for n, s, _ in transcripts.turns(text, names)] == want


SRT = """1
00:00:05,000 --> 00:00:07,000
HOST: Welcome to the show.

2
00:00:07,000 --> 00:00:09,000
It is about salt.

3
00:00:01,500 --> 00:00:03,000
GUEST: 2 grams of it,
um, a day.
"""
VTT = """\ufeffWEBVTT - a show

NOTE Host: this is
no speech

STYLE
::cue { color: red }

intro
00:01.000 --> 00:04.000 align:start position:0%
<v.loud Mirel Oskander>Welcome <00:02.000><c>to</c> the show.</v>

00:04.500 --> 00:06.000
and all of you

00:06.000 --> 00:07.000
<v Dr. Threlk>Thank you.</v>
"""


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_caption_layouts(newline):
    names = transcripts.Names(PEOPLE[:3])
    assert transcripts.turns(SRT.replace("\n", newline), names) == [(1, "guest", "2 grams of it, a day."), (2, "host", "Welcome to the show. It is about salt.")]
    assert transcripts.turns(VTT.replace("\n", newline), names) == [(1, "host", "Welcome to the show. and all of you"), (2, "guest", "Thank you.")]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Guest: yes\n7\nsold", [(1, "guest", "yes 7 sold")]),  # a number that no time follows is speech
        ("[00:10]\n\nHost: Salt.", [(1, "host", "Salt.")]),
        ("Host: one [a remark " + "that goes on and on " * 20 + "] two (sighs)", [(1, "host", "one two")]),
        ("Host: " + "x" * 300 + ". Caller from a very long way down the coast road: hello", [(1, "host", "x" * 300 + "."), (2, "caller", "hello")]),
        ("said mean-while, host: no label\nGuest: yes", [(1, "guest", "yes")]),
    ],
)
def test_layout_details(text, want):
    assert transcripts.turns(text, transcripts.Names(PEOPLE[:3])) == want


def test_turns_of_random_blocks():
    """Blocks of times, sounds, notes and words: a block has a turn exactly if a word that is no filler is in it."""
    rnd = random.Random(4)
    names = transcripts.Names(PEOPLE[:3])
    silent = ["00:01:02.500", "uh", "Um,", "[noise in the hall]", "mm...", "(pause)", "♪ la ♪", "you know,", "*coughs*"]
    for _ in range(400):
        parts, want = [], []
        for k in range(rnd.randint(1, 6)):
            speaker = f"speaker {k}"
            words = [rnd.choice(silent) for _ in range(rnd.randint(0, 12))]
            if rnd.random() < 0.5:
                words.insert(rnd.randint(0, len(words)), "salt")
                want.append(speaker)
            parts.append(f"S{k}: {' '.join(words)}")
        got = transcripts.turns("\n".join(parts), names)
        assert [s for _, s, _ in got] == want
        assert all(x == "salt" for *_, x in got)


def test_found_is_turns_without_speech(spark, data):
    passages, people = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("search_results", "speakers"))
    found = {tuple(r) for r in transcripts.speaker_turns(passages, people).collect()}
    assert found and found == {tuple(r)[:4] for r in transcripts.speaker_turns(passages, people, with_text=True).collect()}


def test_speech_is_clean():
    names = transcripts.Names(PEOPLE[:3])
    (turn,) = transcripts.turns("Host: Um, salt — uh — is [laughter] good *coughs* for you, er... really. ((crosstalk))", names)
    assert turn[2] == "salt is good for you, really."


def test_turns_table(spark):
    rows = [("1", "01_Audio_Transcripts\\a.txt", "Host: yes it is.", None), ("1", "01_Audio_Transcripts\\a.txt", "Host: yes it is.", None), ("2", "x/a.txt", "Host: no.", "Host: no."), (None, "01_Audio_Transcripts/a", "Host: no.", None), ("3", "01_Audio_Transcripts/b", "", "Guest: " + "word " * 100_000)]
    df = spark.createDataFrame(rows, "id string, source_file string, ray_peat_response string, context string").withColumn("speaker", F.lit(1)).withColumn("turn_no", F.lit("x"))
    people = spark.createDataFrame(PEOPLE, "full_name string, speaker_role string")
    assert sorted(tuple(r) for r in transcripts.speaker_turns(df, people).collect()) == [("1", "ray_peat_response", 1, "host"), ("3", "context", 1, "guest")]
    assert transcripts.speaker_turns(df.limit(0), people.limit(0)).count() == 0


# Problem 6


def brute_leaks(docs, items, n=12):
    grams = {}
    for i, *fields in items:
        for f in fields:
            w = common.plain_words(f or "")
            for k in range(len(w) - n + 1):
                grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = common.plain_words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_leaks_against_brute_force(spark):
    rnd = random.Random(11)
    few = WORDS[:25]
    items = [(f"e{i}", " ".join(rnd.choice(few) for _ in range(rnd.randint(5, 30))), " ".join(rnd.choice(WORDS) for _ in range(40))) for i in range(25)]
    docs = []
    for d in range(120):
        w = [rnd.choice(few + WORDS) for _ in range(80)]
        if d % 3 == 0:
            src = common.plain_words(rnd.choice(items)[rnd.choice([1, 2])])
            k = rnd.randint(8, 20)
            at = rnd.randint(0, max(0, len(src) - k))
            w[30 : 30 + k] = src[at : at + k]
        docs.append((d, " ".join(w)))
    docs += [(1000, None), (1001, ""), (0, docs[0][1])]
    items += [("none", None, ""), ("e0", items[0][1], items[0][2])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", F.lit(1)).withColumn("item_id", F.lit("x"))
    ev = spark.createDataFrame(items, "id string, question string, reference_answer string").withColumn("term", F.lit(2))
    want = brute_leaks(docs, items)
    assert want and {tuple(r) for r in leakage.leaks(leakage.matches(df, ev)).collect()} == want
    assert {tuple(r) for r in leakage.leaks(leakage.matches(df, ev, max_vocabulary=3)).collect()} == want
    assert leakage.matches(df.limit(0), ev).count() == 0 and leakage.matches(df, ev.limit(0)).count() == 0


def test_near_matches(spark):
    """An item with a word changed every eleven words, with words inserted or two exchanged has no exact run, and comes out as near."""
    rnd = random.Random(12)
    text = [rnd.choice(WORDS) for _ in range(44)]
    changed = [w if k % 11 else "other" for k, w in enumerate(text)]
    inserted = [x for k, w in enumerate(text) for x in ([w, "well"] if k % 9 == 5 else [w])]
    exchanged = [text[k + (1, -1)[k % 2]] if k % 10 in (4, 5) else w for k, w in enumerate(text)]
    shuffled = rnd.sample(text, len(text))
    filler = [rnd.choice(WORDS) for _ in range(60)]
    docs = [(k, " ".join(filler + w + filler)) for k, w in enumerate([text, changed, inserted, exchanged, shuffled[:20] + filler * 9 + shuffled[20:], []])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ev = spark.createDataFrame([("e", " ".join(text), None)], "id string, question string, reference_answer string")
    got = {r.doc_id: r for r in leakage.matches(df, ev, near=True).collect()}
    assert {k: r.kind for k, r in got.items()} == {0: "exact", 1: "near", 2: "near", 3: "near"}
    assert got[0].share == 1.0 and all(got[k].matched_words >= 36 and got[k].share > 0.8 for k in (1, 2, 3))
    assert {r.doc_id for r in leakage.leaks(leakage.matches(df, ev)).collect()} == {0}
    assert leakage.matches(df.limit(0), ev, near=True).count() == 0 and leakage.matches(df, ev.limit(0), near=True).count() == 0
    cols = ["doc_id", "item_id", "field", "longest_run", "matched_words", "first_pos"]
    both = leakage.matches(df.unionByName(df), ev, near=True, max_vocabulary=3)
    assert both.count() == len(got)  # repeated rows count once, also with all terms stored
    assert {tuple(r) for r in both.filter("kind = 'exact'").select(*cols).collect()} == {tuple(r) for r in leakage.matches(df, ev).select(*cols).collect()}


def test_plain_words():
    assert common.plain_words("The <b>Café</b> &amp; mars-\nhland x; qu&#39;il sÃ©ché") == ["the", "cafe", "marshland", "x", "qu", "il", "seche"]


# Problem 7


def test_mixture(spark):
    rnd = random.Random(2)
    docs = [(i, "Article " if i % 3 else "forums", text_of(rnd, rnd.randint(3, 30))) for i in range(300)] + [(1000, "article", None), (1001, "article", ""), (None, "article", "x"), (1002, None, "lost"), (1003, "poem", "not a target")]
    goal = [("article", 0.3, 1), ("forum", 0.5, 3), ("email", 0.2, 2), (None, 0.1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("tokens", F.lit("x"))
    targets = spark.createDataFrame(goal, "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mixture(df, targets)
    s = {r.source: r for r in shares.collect()}
    c = chosen.collect()
    for name in ("article", "forum"):
        own = [r for r in c if r.source == name]
        assert sum(r.tokens * r.repeats for r in own) == s[name].used_tokens and abs(s[name].used_tokens - s[name].budget_tokens) <= 40
        assert max(r.repeats for r in own) <= s[name].max_repeats
    assert abs(s["article"].used_tokens / (s["article"].used_tokens + s["forum"].used_tokens) - 0.375) < 0.02
    assert s["email"].used_tokens == 0 and set(s) == {"article", "forum", "email"}
    assert {r.doc_id for r in mixing.mixture(df, targets)[0].collect()} == {r.doc_id for r in c}
    assert all(r.used_tokens == 0 for r in mixing.mixture(df.limit(0), targets)[1].collect())
    assert mixing.mixture(df, targets.limit(0))[1].count() == 0


def test_prefix_sums(spark):
    docs = spark.createDataFrame([(i, "article" if i % 4 else "email", "a b c") for i in range(200)], "doc_id long, source string, text string")
    for name, rows in (("article", 150), ("email", 50)):
        got = sorted(r.upto for r in mixing.ordered(docs).filter(F.col("source") == name).collect())
        step = got[0]
        assert got == [step * (k + 1) for k in range(rows)]


# Problem 8

BAD = {
    "abusive": ["You are a worthless pig and everybody knows it.", "You are a w0rthl3ss p.i.g and everybody knows it.", "Halt dein Maul, du Trottel.", "I know where you live and I will break your jaw.", "No eres más que un іdiota patético.", "Ferme ta gueule, espèce de sa**ud."],
    "hateful": ["Immigrants are vermin and should be driven out of our town.", "Les étrangers sont de la v3rm1n3 qu'il faut chasser.", "Die Alten vermehren sich wie R4tt3n und verdienen keine Medizin.", "Los refugiados son una plaaaaga y hay que echarlos."],
    "sexual": ["Watch horny adult girls strip live on cam tonight.", "Best p0rn0 videos with mature couples, free trial.", "Singles in your area want to f**k now, click the profile."],
}
FINE = [
    "I was an idiot to skip breakfast for so long, but my own stupid mistake taught me a lot.",
    "It is wrong and cruel to say that immigrants do not deserve medicine.",
    "Breast tenderness and vaginal dryness often improve when estrogen falls, and libido returns.",
    "The cock crowed, the bitch had seven pups, and the ass refused to move.",
    "Antiseptics kill bacteria, and some dyes kill parasites in the gut.",
    "In young rats, salt raises the pulse.",
]


def test_categories(spark):
    rows, want = [], set()
    for c, texts in BAD.items():
        for t in texts:
            rows.append((len(rows), f"Salt is low. {t}\n\nMilk helps."))
            want.add((len(rows) - 1, c))
    rows += [(100 + i, t) for i, t in enumerate(FINE)] + [(900, None), (901, ""), (None, BAD["abusive"][0]), (902, "salt " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("abusive", F.lit("x")).withColumn("source", F.lit("Forum "))
    labels = spark.createDataFrame([(0, 1), (0, None), (100, 0), (100, 1), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.scores(df, labels)
    assert {tuple(r) for r in toxicity.flagged(scored).collect()} == want
    assert scored.count() == len(rows) - 1
    rate = toxicity.rates(df.filter("doc_id IS NOT NULL"), scored).collect()
    assert [(r.source, r.documents, r.flagged) for r in rate] == [("forum", len(rows) - 1, len(want))]
    assert toxicity.flagged(toxicity.scores(df.limit(0), labels.limit(0))).count() == 0


def test_training_learns_from_document_labels():
    """Noisy-or training lifts a word that only the labels mark, with no cue in the prior."""
    import numpy as np

    rnd = random.Random(1)
    finder = toxicity.automaton()

    def bag(extra):
        out = []
        for s in [f"{rnd.choice(WORDS)} {rnd.choice(WORDS)} women walk."] + ([f"{extra} women {rnd.choice(WORDS)}."] if extra else []):
            for _, _, x, cues in toxicity.sentences(s, finder):
                out.append(toxicity.features(x, cues))
        return out

    train = [(bag("zorgblat"), 1.0) for _ in range(40)] + [(bag(None), 0.0) for _ in range(40)]
    w = toxicity.train(train, rounds=600)

    def score(b):
        keep = np.ones(len(toxicity.CATEGORIES))
        for named, hashed in b:
            z = w[:, named].sum(axis=1) + w[:, [len(toxicity.FEATURES) + h for h in hashed]].sum(axis=1) / max(1, len(hashed)) ** 0.5
            keep *= 1 - 1 / (1 + np.exp(-z))
        return max(1 - keep)

    held = [score(bag("zorgblat")) for _ in range(20)], [score(bag(None)) for _ in range(20)]
    assert min(held[0]) > max(held[1])


def test_sentences_without_cues_are_learnt_and_scored(spark):
    """A sentence that only labels mark, without any cue, is learnt and found in texts without labels; length alone flags nothing."""
    rnd = random.Random(2)
    bad = "Crawl back to zorgland, glimmer toad."
    words = [f"{a}{b}{c}" for a in ("bal", "dor", "fim", "gun") for b in ("ka", "lo", "mi", "nu") for c in ("rt", "sk", "pf", "nd")]

    def plain(n):
        return " ".join(f"{' '.join(rnd.choice(words) for _ in range(8))}." for _ in range(n))

    rows = [(i, plain(10) + (f" {bad}" if i % 10 == 0 else "")) for i in range(400)]
    rows.append((1000, plain(3000)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)], "doc_id long, toxic int")
    scored = toxicity.scores(df, labels)
    assert {r.doc_id for r in toxicity.flagged(scored).collect()} == {i for i in range(400) if i % 10 == 0}
    top = max(scored.filter("doc_id = 390").collect()[0].asDict().items(), key=lambda kv: kv[1] if kv[0] in toxicity.CATEGORIES else -1)[0]
    row = scored.filter("doc_id = 390").collect()[0]
    assert rows[390][1][row[f"{top}_from"] : row[f"{top}_to"]].strip() == bad


@pytest.mark.parametrize("text", ["a" * 1_000_000, "\n" * 300_000, "a-" + "\n" * 200_000, " " * 300_000 + "x", ("- " * 200_000), "ab" * 400_000 + " aaa", "[" * 200_000, "00:10 " * 100_000, "<b" * 100_000, "*" * 200_000, "i d " * 100_000])
def test_no_text_takes_long(text):
    """Runs of one thing, however long, are read in time proportional to their length."""
    import time

    finder, names = toxicity.automaton(), transcripts.Names(PEOPLE[:3])
    began = time.process_time()
    toxicity.sentences(text, finder)
    transcripts.turns(text, names)
    transcripts.turns("Host: " + text, names)
    splitting.split(text, 1000, 100)
    common.plain_words(text)
    near_duplicates.words_of(text)
    token_budget.language(text)
    qa_defects.is_empty(text), qa_defects.is_truncated(text), qa_defects.is_echo("what is it", text)
    assert time.process_time() - began < 20
