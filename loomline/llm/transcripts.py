"""Speech transcripts into clean speaker turns.

Each text is read line by line by a finite-state parser. Its states are BETWEEN (nothing open), CUE (a cue number or a
time has been read and its text is due), SPEECH (text of a block) and COMMENT (header or comment block of a caption file,
up to the next blank line). The layouts known are caption files (SRT; WebVTT with voice tags, cue settings, headers and
comments), and transcripts with labels in brackets, before a colon or before a dash, several on a line or none, with the
time before the label, behind it or on a line of its own. Labels are resolved to roles, persons of the speakers table or
numbers; a line without a label goes on with the block before. Each block is stripped of times, annotations and
hesitation; blocks without speech are dropped and neighbours of one speaker joined.

A label has at most as many words as the longest known name and eight more (title, place, number). Any bracketed remark
is an annotation, whatever its length.

Nulls: a null id, text or text without speaker labels gives no turns. The speakers table may be empty (roles
and numbers are still known); names that are null are ignored. Repeated rows give their turns once. Extra
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import clean_path

# Words that name a role, in the four languages, folded to lower case without accents.
ROLES = {
    "host": (
        "host hostess interviewer moderator presenter anchor q question frage pregunta moderatorin gastgeber gastgeberin interviewerin sprecherin moderadora moderador presentador presentadora entrevistador "
        "entrevistadora anfitrion anfitriona animateur animatrice presentateur presentatrice moderateur moderatrice intervieweur intervieweuse hote hotesse praesentator conductor conductora locutor locutora"
    ).split(),
    "guest": (
        "guest expert doctor dr a answer antwort reponse respuesta gast experte expertin arzt arztin doktor doktorin invitado invitada experto experta doctora medico medica invite invitee experte docteur docteure medecin"
    ).split(),
    "caller": (
        "caller listener anrufer anruferin hoerer hoererin horer horerin zuhorer zuhorerin oyente llamante radioyente auditeur auditrice appelant appelante"
    ).split(),
}
ROLE_OF = {w: r for r, ws in ROLES.items() for w in ws}

# Hesitation sounds and filler phrases, folded; a block of nothing else has no speech.
FILLERS = (
    "you know|i mean|sort of|kind of|tu vois|vous voyez|weisst du|weiszt du|weißt du|sozusagen|o sea|es decir|digamos|enfin|bueno|este|pues|also|"
    "u+h+m*|u+m+|e+r+m*|h+m+|m+h*m+|m+|a+h+|o+h+|a+h+m+|e+u+h+|h+e+u+|e+h+m*|e+m+|ahm|ah|oh|aeh|aehm|ähm?|öhm?|ben|bah"
)
FILLER = re.compile(rf"\b(?:{FILLERS})\b")
FILLER_PART = re.compile("|".join(dict.fromkeys(p for f in FILLERS.split("|") for p in f.split())))
WORD = re.compile(r"[^\W_]+")
# The same sounds and phrases as they stand in running speech, with both cases spelt out: a pattern that begins with a class of letters is
# searched fast. The look-behind asks for a blank or a comma before the sound.
SOUND = (
    r"[UuEeHhMmÄäYyIiSsTtWwDdOo](?<![^\s,].)(?:(?<=[Uu])[Uu]*(?:[Hh]+[Mm]*|[Mm]+)|(?<=[Ee])[Ee]*(?:[Rr]+[Mm]*|[Uu]+[Hh]+|[Hh]+[Mm]*|[Mm]+)|(?<=[Hh])[Hh]*(?:[Mm]+|[Ee]+[Uu]+)|(?<=[Mm])[Mm]*(?:[Hh]+[Mm]+|[Mm])"
    r"|(?<=[Ää])[Ää]*[Hh]+[Mm]*|(?<=[Yy])ou know|(?<=[Ii]) mean|(?<=[Ss])ort of|(?<=[Tt])u vois|(?<=[Ee])nfin|(?<=[Ww])eißt du|(?<=[Ss])ozusagen|(?<=[Dd])igamos|(?<=[Oo]) sea)"
)
SOUNDS = re.compile(SOUND + r"\b(?:\.\.\.|[,.…])?(?=\s|$)")
BETWEEN_DASHES = re.compile(rf"[—–-]\s+{SOUND}\s+[—–-]\s+")
ENDS_IN_SOUND = re.compile(SOUND + r"[,.…]*$")
NOTE = re.compile(r"\(\([^()]*\)\)|\[[^\[\]\n]*\]|\([^()\n]*\)|\{[^{}\n]*\}|</?[^\W\d_][^<>\n]*>|(?<!\*)\*(?!\*)[^*\n]+\*(?!\*)|[♪🎶][^♪🎶\n]*[♪🎶]|[♪🎶]")
OPENS_NOTE = re.compile(r"[\[({<*♪🎶]")
BLANKS = re.compile(r"\s+")
BEFORE_MARK = re.compile(r"\s+([,.;:!?])")

TIME = r"(?:[\[(<] ?)?(?<!\d)\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?(?!\d)(?: ?[\])>])?"
TIME_RE = re.compile(TIME)
TIME_END = re.compile(rf"{TIME}$")
CLOCK = re.compile(r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,](\d{1,3}))?")
CUE_TIMES = re.compile(rf"({TIME})\s*(?:-->|→)\s*{TIME}((?:\s+[a-z]+:\S+)*)")
HEADER = re.compile(r"\ufeff?WEBVTT\b")
COMMENT = re.compile(r"(?:NOTE|STYLE|REGION)\b")
LINES = re.compile(r"\r\n|\r|\n")
NAME = r"[^\W\d_][^\s:\[\]()<>*]*(?:[ \t]+[^\s:\[\]()<>*]+)*?"
SUFFIX = r"(?:[ \t]*\([^\d()]*\d{1,3}\))?"
VOICE = re.compile(r"<v(?:\.[^\s<>.]+)*[ \t]+([^<>\n]+)>")
BRACKET = re.compile(rf"(?:\[({NAME}{SUFFIX})(?:[ \t]+({TIME}))?\]|<({NAME}{SUFFIX})>)[ \t]*:?(?=\s|$)")
MARK = re.compile(r"[:：](?=(?:\*\*|__)?(?:\s|$))|(?<=[ \t\])])[-–](?=\s|$)")
STARTS = re.compile(r"(?:(?<=[\s*_>\])])|^)[^\W_]")
NUMBERED = re.compile(r"^(?:speaker|sprecher|sprecherin|hablante|locuteur|locutrice|intervenant|spk|s|voice|stimme|voix|voz|orador|locutor)[\s_#-]*0*(\d{1,3})$")
CALLER_FROM = re.compile(r"^(\w+)\s+(?:(?:from|on line|line|de|du|des|aus|von|depuis|desde|en)\s+[\w' -]+|#?\s*\d+)$")
MARKS = " \t>|-–—*_#"
FREE_AFTER = set(".!?…:;])}>*_♪🎶\"”»")

BETWEEN, CUE, SPEECH, COMMENT_BLOCK = range(4)


def fold(s: str) -> str:
    t = s.lower().replace("ß", "ss")
    if t.isascii():
        return t
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def near(a: str, b: str) -> bool:
    """At most one letter missing, added, changed, or two neighbours exchanged."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class Names:
    """Resolves a label to its speaker; remembers what it has seen."""

    def __init__(self, people: list[tuple[str, str]]):
        self.people = []
        for name, role in people:
            if name and role:
                words = fold(name).split()
                self.people.append((words, role))
        self.label_words = 8 + max((len(w) for w, _ in self.people), default=2)
        self.seen: dict[str, str | None] = {}

    def speaker(self, label: str) -> str | None:
        label = label.strip(" \t*_-–—>|\"'")
        if label not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[label] = self._resolve(label)
        return self.seen[label]

    def _resolve(self, label: str) -> str | None:
        t = re.sub(r"\s*\([^)]*\)$", "", fold(label)).strip()
        m = NUMBERED.match(t)
        if m:
            return f"speaker {int(m.group(1))}"
        if t in ROLE_OF:
            return ROLE_OF[t]
        m = CALLER_FROM.match(t)
        if m and ROLE_OF.get(m.group(1)) == "caller":
            return "caller"
        m = re.match(r"^(\w+)\s*[-_#]?\s*\d+$", t)
        if m and m.group(1) in ROLE_OF and len(m.group(1)) > 1:
            return ROLE_OF[m.group(1)]
        if re.fullmatch(r"(?:[a-z]\.\s?){2,3}|[a-z]\.?[a-z]\.?", t):
            letters = re.sub(r"[^a-z]", "", t)
            roles = {r for words, r in self.people if "".join(w[0] for w in words) == letters}
            return roles.pop() if len(roles) == 1 else None
        t = re.sub(r"^(?:dr|prof|mr|mrs|ms|herr|frau|m|mme|sr|sra|don|dona|doctor|doctora|docteur|doktor)\.?\s+", "", t)
        words = [w.strip(".,") for w in re.split(r"[\s,]+", t) if w.strip(".,")]
        if not words:
            return None
        best: dict[str, int] = {}
        for own, role in self.people:
            score = 0
            if all(any(w == o or (len(w) == 1 and o.startswith(w)) for o in own) for w in words) and any(len(w) > 1 for w in words):
                score = 3
            elif all(any(w == o or (len(w) == 1 and o.startswith(w)) or (len(w) >= 4 and near(w, o)) for o in own) for w in words) and any(len(w) > 3 for w in words):
                score = 2
            elif len(words) > 1 and near("".join(words), "".join(own)):
                score = 1
            if score:
                best[role] = max(best.get(role, 0), score)
        top = max(best.values(), default=0)
        roles = [r for r, s in best.items() if s == top]
        return roles[0] if len(roles) == 1 else None


def clock(text: str) -> float:
    h, m, s, ms = CLOCK.search(text).groups()
    if s is None:
        h, m, s = "0", h, m
    return int(h) * 3600 + int(m) * 60 + int(s) + int((ms or "0").ljust(3, "0")) / 1000


def back_over_marks(line: str, low: int, at: int, seen: tuple[int, int] = (-1, -1)) -> int:
    """Where the run of marks and blanks before ``at`` begins; ``seen`` is a place with its answer, so that no run is read twice."""
    while at > low and line[at - 1] in MARKS:
        at -= 1
        if at == seen[0]:
            return max(low, seen[1])
    return at


def time_before(line: str, low: int, at: int) -> tuple[int, str] | None:
    """Place and text of a time that stands right before ``at``, but for marks."""
    k = back_over_marks(line, low, at)
    close = 1 if line[k : k + 1] == ">" else 0  # the bracket of a time is also a mark
    m = TIME_END.search(line[max(low, k - 24) : k + close]) or TIME_END.search(line[max(low, k - 24) : k])
    return (max(low, k - 24) + m.start(), m.group(0)) if m else None


def is_free(line: str, low: int, at: int) -> bool:
    """A label may begin here: at the head of a line, after a sentence, a mark, an annotation or a sound."""
    k = back_over_marks(line, low, at)
    if k == 0 or line[k - 1] in FREE_AFTER or any(c in ">*_" for c in line[k:at]):
        return True
    head = line[max(low, k - 32) : k]
    return k < at and bool(ENDS_IN_SOUND.search(head))


def labels(line: str, names: Names) -> list[tuple[int, int, str, str | None]]:
    """(start, end, speaker, time) of each speaker label of a line; the start takes in a time before the label."""
    found: list[tuple[int, int, str, str | None]] = []
    if "<v" in line:
        for m in VOICE.finditer(line):
            s = names.speaker(m.group(1))
            if s:
                found.append((m.start(), m.end(), s, None))
    if "[" in line or "<" in line:
        low = 0
        for m in BRACKET.finditer(line):
            s = names.speaker(m.group(1) or m.group(3))
            before = s and time_before(line, low, m.start())
            if s and (before or is_free(line, low, m.start())):
                found.append((before[0] if before and not m.group(2) else m.start(), m.end(), s, m.group(2) or (before[1] if before else None)))
                low = m.end()
    starts: list[int] | None = None
    low, seen = 0, (-1, -1)
    for mark in MARK.finditer(line):
        at, end, dash = mark.start(), mark.end(), mark.group(0) in "-–"
        stop = back_over_marks(line, low, at, seen) if line[at - 1 : at] in ("*", "_", " ", "\t") else at
        seen = at, stop
        inner = TIME_END.search(line[max(low, stop - 24) : stop])
        if inner:
            stop = back_over_marks(line, low, max(low, stop - 24) + inner.start())
        if stop <= low:
            continue
        if starts is None:
            starts = [m.start() for m in STARTS.finditer(line)]
        j = bisect_left(starts, stop)
        for st in starts[max(0, j - names.label_words) : j]:
            if st < low:
                continue
            label = line[st:stop]
            s = names.speaker(label)
            if not s:
                continue
            before = time_before(line, low, st)
            if before or is_free(line, low, st) or (not dash and label[0].isupper() and len(label) > 2):
                if line.startswith(("**", "__"), end):
                    end += 2
                found.append((before[0] if before and not inner else st, end, s, inner.group(0) if inner else before[1] if before else None))
                low = end
                break
    if len(found) > 1:
        found.sort()
        kept = found[:1]
        for x in found[1:]:
            if x[0] >= kept[-1][1]:
                kept.append(x)
        return kept
    return found


def blocks(text: str, names: Names) -> list[tuple[float | None, str, str]]:
    """(time, speaker, raw text) of each labelled block, in order of appearance."""
    state, captions, due = BETWEEN, False, None  # ``due``: a time that waits for its label
    out: list[tuple[float | None, str, list[str]]] = []
    lines = LINES.split(text)
    for n, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            state = BETWEEN
            continue
        cue = CUE_TIMES.match(bare) if ">" in bare or "→" in bare else None
        if state == COMMENT_BLOCK and not cue:
            continue
        if cue:
            state, due, line = CUE, cue.group(1), bare[cue.end() :]
            if not line.strip():
                continue
        elif HEADER.match(bare) and not out:
            state, captions = COMMENT_BLOCK, True
            continue
        elif captions and state == BETWEEN and COMMENT.match(bare):
            state = COMMENT_BLOCK
            continue
        elif (bare.isdigit() or (captions and state == BETWEEN)) and n + 1 < len(lines) and CUE_TIMES.match(lines[n + 1].strip()):
            state = CUE  # number or name of a cue
            continue
        elif bare[-1] in "0123456789])>" and TIME_RE.fullmatch(bare):
            state, due = CUE, bare
            continue
        state = SPEECH
        at = labels(line, names) if ":" in line or "[" in line or "<" in line or "-" in line or "–" in line or "：" in line else []
        if not at:
            if out:
                out[-1][2].append(line)
        else:
            if out:
                out[-1][2].append(line[: at[0][0]])
            for k, (start, end, speaker, time) in enumerate(at):
                if time is None and k == 0 and due is not None and not line[:start].strip(MARKS):
                    time = due
                out.append((clock(time) if time else None, speaker, [line[end : at[k + 1][0] if k + 1 < len(at) else len(line)]]))
        tail = TIME_END.search(line[-24:].rstrip()) if line[-1:] in "0123456789])> \t" else None
        due = tail.group(0) if tail else None
    return [(time, speaker, "\n".join(parts)) for time, speaker, parts in out]


def clean(block: str) -> str:
    """Speech without annotations, times and hesitation."""
    t = NOTE.sub(" ", block) if OPENS_NOTE.search(block) else block
    if ":" in t:
        t = TIME_RE.sub(" ", t)
    t = BLANKS.sub(" ", t)
    if " — " in t or " - " in t or " – " in t:
        t = BETWEEN_DASHES.sub(" ", t)
    t = SOUNDS.sub(" ", t)
    if "**" in t or "__" in t:
        t = t.replace("**", "").replace("__", "")
    t = BLANKS.sub(" ", t)
    return BEFORE_MARK.sub(r"\1", t).strip(" ,-–—>")


def has_speech(cleaned: str) -> bool:
    """A word is left that is no hesitation: one that no filler has, or one beyond the fillers."""
    if any(not FILLER_PART.fullmatch(fold(m.group(0))) for m in WORD.finditer(cleaned)):
        return True
    return bool(WORD.search(FILLER.sub(" ", fold(cleaned))))


def turns(text: str | None, names: Names) -> list[tuple[int, str, str]]:
    """(turn number from 1, speaker, speech) of a text."""
    if not text:
        return []
    found = blocks(text, names)
    if found and all(b[0] is not None for b in found):
        found.sort(key=lambda b: b[0])
    out: list[list] = []
    for _, speaker, raw in found:
        speech = clean(raw)
        if not has_speech(speech):
            continue
        if out and out[-1][1] == speaker:
            out[-1][2].append(speech)
        else:
            out.append([len(out) + 1, speaker, [speech]])
    return [(n, speaker, " ".join(parts)) for n, speaker, parts in out]


def _parse(people: list[tuple[str, str]], with_text: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(people)
        for pdf in frames:
            rows = []
            for col in ("ray_peat_response", "context"):
                for i, t in zip(pdf["id"], pdf[col], strict=True):
                    if isinstance(t, str):
                        rows += [(i, col, n, s, *([x] if with_text else [])) for n, s, x in turns(t, names)]
            yield pd.DataFrame(rows, columns=["id", "col_name", "turn_no", "speaker", *(["speech"] if with_text else [])])

    return run


def speaker_turns(search_results: DataFrame, speakers: DataFrame, with_text: bool = False, max_people: int = 100_000) -> DataFrame:
    """(id, col_name, turn_no, speaker[, speech]) of the passages whose file is an audio transcript.

    ``with_text`` only adds the column of the speech; the turns are the same with and without. The speakers table is sent to the
    tasks; above ``max_people`` rows this raises rather than cut it short.
    """
    people = [tuple(r) for r in speakers.filter("full_name IS NOT NULL").select("full_name", "speaker_role").distinct().limit(max_people + 1).collect()]
    if len(people) > max_people:
        raise ValueError("too many speakers to send to the tasks")
    rows = search_results.filter(F.col("id").isNotNull() & clean_path(F.col("source_file")).startswith("01_Audio_Transcripts/")).select("id", "ray_peat_response", "context")
    schema = "id string, col_name string, turn_no int, speaker string" + (", speech string" if with_text else "")
    return rows.mapInPandas(_parse(people, with_text), schema).distinct()
