"""Broken prompt and response pairs.

Each row is judged on its own, so the operator is one narrow map over the rows of
the question log: no shuffle but the last distinct. A suffix automaton of the
question measures how much of the answer is copied from it, an Aho-Corasick
automaton of the parts of refusals finds answers that decline, a stack of delimiters
finds what was opened and not closed, and stopword votes compare the languages.

Nulls: a null answer is ``empty``; a null question makes echo and language
checks impossible, the other checks still run. Rows without a null id and with
the same id give one row: the most severe defect in the order of ``DEFECTS``.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.languages import CODES, NAME_TO_CODE, votes
from loomline.llm.refusals import declines

DEFECTS = ("empty", "refusal", "echo", "truncated", "wrong_language")

# What stands where an answer should be.
PLACEHOLDERS = {"n/a", "na", "none", "null", "nil", "nan", "tbd", "todo", "undefined", "no answer", "answer", "antwort", "réponse", "respuesta", "response", "reply", "keine antwort", "sin respuesta", "aucune réponse", "pas de réponse"}

# Sentences of courtesy, which are no answer by themselves.
COURTESY = [
    "rephrase", "ask something else", "asking about something else", "another question", "consult a", "see a doctor", "ask a doctor", "ask your doctor", "ask a clinician", "speak to a doctor", "thank you for", "thanks for", "i appreciate", "good question", "i am sorry", "my apologies", "i apologise", "i apologize", "hope you understand",
    "reformuler", "merci pour", "merci de", "consultez", "une autre question", "je suis desole", "mes excuses", "adressez-vous a", "demandez a un medecin",
    "anders fragen", "andere frage", "danke fur", "fragen sie einen", "fragen sie bitte", "wenden sie sich", "tut mir leid", "bitte um verstandnis", "entschuldigung",
    "otra pregunta", "gracias por", "consulte a", "reformular", "lo siento", "disculpe", "pregunte a un medico", "acuda a un",
]

# How an answer repeats that it was asked something.
ASKED = ["you want to know about this", "you asked", "you are asking", "your question", "vous demandez ceci", "vous demandez", "votre question", "ihre frage lautet", "sie fragen", "usted pregunta", "su pregunta"]

# Announced numbers and the words that count the points.
NUMBERS = {
    "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "seis": 6, "sechs": 6,
    "zwei": 2, "drei": 3, "vier": 4, "funf": 5, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5,
}
POINTS = r"(?:things?|points?|reasons?|steps?|factors?|choses|raisons|etapes|facteurs|punkte|dinge|grunde|schritte|cosas|puntos|razones|pasos|factores)"
ORDINALS = [
    r"first(?:ly)?|premierement|d'abord|erstens|primero",
    r"second(?:ly)?|deuxiemement|ensuite|zweitens|segundo",
    r"third(?:ly)?|troisiemement|enfin|drittens|tercero",
    r"fourth(?:ly)?|quatriemement|viertens|cuarto",
    r"fifth(?:ly)?|cinquiemement|funftens|quinto",
    r"sixth(?:ly)?|sechstens|sexto",
]
ANNOUNCED = re.compile(rf"^\W*(?:here are |there are |voici |il y a |es gibt |hay )?({'|'.join(NUMBERS)})\s+(?:\w+\s+)?{POINTS}\b")
ORDINAL_RE = [re.compile(rf"(?:^|[.:;!?]\s+|\n)\W*(?:{x})\b") for x in ORDINALS]

CITED = re.compile(r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]|\((?:source|quelle|fuente)\s+\d+\)", re.I)
CITATIONS = re.compile(r"\[\d+(?:\s*,\s*\d+)*\]|\((?:source|quelle|fuente)\s+\d+\)", re.I)
ITEM = re.compile(r"^\s*(?:\d+[.)]|[-*•–])\s+\S")
BARE_ITEM = re.compile(r"^\s*(?:\d+[.)]|[-*•])\s*$")
HEADING = re.compile(r"^\s*(?:\*\*[^*\n]+\*\*|__[^_\n]+__|#{1,6}\s+[^\n]+|[^\n.!?]{1,40}:)\s*$")
TAG = re.compile(r"<[^<>\n]{0,300}>|&nbsp;")
INVISIBLE = re.compile("[​-‏⁠﻿­]")
# Sentences, and what is set against the first half of one: the second half may be an answer after regret or reserve.
CLAUSE = re.compile(r"(?<=[.!?…])\s+|\n+|[,;:–—]\s+(?=(?:but|however|aber|jedoch|mais|cependant|pero|sin embargo)\b)")
WORD = re.compile(r"[^\W_]+")
LANGUAGE_ASKED = re.compile(r"\b(?:in|auf|en)\s+(" + "|".join(sorted(NAME_TO_CODE, key=len, reverse=True)) + r")\b")


def fold(text: str) -> str:
    """Lower case without accents, with plain apostrophes."""
    t = unicodedata.normalize("NFKD", text.lower().replace("’", "'").replace("ß", "ss"))
    return "".join(c for c in t if not unicodedata.combining(c))


class SuffixAutomaton:
    """Suffix automaton of a word sequence; ``runs`` traverses it with another sequence."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            cur = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            else:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = self._state(self.length[p] + 1, dict(self.next[q]))
                    self.link[clone] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def _state(self, length: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        return len(self.length) - 1

    def runs(self, words: list[str]) -> list[int]:
        """For each word, the length of the longest run of the automaton's sequence that ends there."""
        state, size, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            else:
                state, size = 0, 0
            out.append(size)
        return out


def copied_words(question: list[str], answer: list[str], least: int) -> list[bool]:
    """Which words of the answer lie in a run of at least ``least`` words of the question."""
    runs = SuffixAutomaton(question).runs(answer)
    out = [False] * len(answer)
    for i, n in enumerate(runs):
        if n >= least:
            for k in range(i - n + 1, i + 1):
                out[k] = True
    return out


def _automaton(phrases: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, p)
    a.make_automaton()
    return a


def is_empty(answer: str | None) -> bool:
    """No words of its own: blanks, marks, a placeholder, a bare heading or citation numbers."""
    if answer is None:
        return True
    t = CITATIONS.sub(" ", TAG.sub(" ", INVISIBLE.sub("", answer))).strip()
    words = WORD.findall(t)
    if not words:
        return True
    bare = t.strip("*_#:.-–—[](){}<>\"' \t\r\n").lower()
    if bare in PLACEHOLDERS:
        return True
    return bool(HEADING.match(t)) and "?" not in t and len(words) <= 8 and (t[0] in "*_#" or t.endswith(":"))


def is_refusal(answer: str, courtesy, asked) -> bool:
    """A sentence declines, and none is left that says something else."""
    found = False
    for s in CLAUSE.split(fold(answer)):
        if not WORD.search(CITATIONS.sub("", s)):
            continue
        if declines(s):
            found = True
        elif not next(courtesy.iter(s), None) and not next(asked.iter(s), None) and len(WORD.findall(s)) > 3:
            return False
    return found


def is_echo(question: str, answer: str, least: int = 3, coverage: float = 0.8) -> bool:
    """At least ``coverage`` of the answer's words are copied from the question in runs of ``least`` words or more."""
    body = fold(CITATIONS.sub(" ", TAG.sub(" ", answer)))
    for a in ASKED:
        if body.lstrip("*_ \n").startswith(a):
            body = body.lstrip("*_ \n")[len(a) :]
            break
    q, a = WORD.findall(fold(question)), WORD.findall(body)
    if not q or not a:
        return False
    least = min(least, len(q))
    covered = copied_words(q, a, least)
    return sum(covered) >= coverage * len(a) and len(a) >= min(4, len(q))


def without_last_citations(text: str) -> str:
    """The text without citation numbers and blanks at its end, however many sources they name."""
    t = text.rstrip()
    while t.endswith(("]", ")")):
        m = CITED.fullmatch(t, t.rfind("[" if t.endswith("]") else "("))
        if not m:
            break
        t = t[: m.start()].rstrip()
    return t


def open_delimiters(text: str) -> bool:
    """A stack of delimiters: something was opened and isn't closed at the end."""
    stack: list[str] = []
    pairs = {")": "(", "]": "[", "}": "{", "»": "«"}
    i = 0
    while i < len(text):
        c = text[i]
        if text.startswith("**", i) or text.startswith("__", i):
            mark = text[i : i + 2]
            if mark in stack:
                del stack[stack.index(mark) :]
            else:
                stack.append(mark)
            i += 2
            continue
        if c in '"“”„':
            quote = next((x for x in stack if x in '"“„'), None)
            if quote and not (c == "„"):
                del stack[stack.index(quote) :]
            elif c != "”":
                stack.append(c)
        elif c in "([{«":
            stack.append(c)
        elif c in pairs and pairs[c] in stack:
            del stack[len(stack) - 1 - stack[::-1].index(pairs[c]) :]
        i += 1
    return bool(stack)


def is_truncated(answer: str, few: int = 5) -> bool:
    """Ends before its sentence, quotation, list or announced count of points is complete."""
    t = without_last_citations(INVISIBLE.sub("", answer))
    lines = [x for x in t.splitlines() if x.strip()]
    if not lines:
        return False
    last = lines[-1]
    if BARE_ITEM.match(last) and len(lines) > 1:
        return True
    if open_delimiters(t):
        return True
    folded = fold(t)
    m = next((m for m in map(ANNOUNCED.match, folded.splitlines()) if m), None)
    if not m:
        head = re.search(rf"(?:^|[.!?:]\s+)({'|'.join(NUMBERS)})\s+{POINTS}\s+(?:matter|count|comptent|zahlen|importan|cuentan)\b", folded)
        m = head
    if m:
        points = sum(bool(x.search(folded)) for x in ORDINAL_RE)
        items = sum(bool(ITEM.match(x)) for x in lines)
        if max(points, items) < NUMBERS[m.group(1)]:
            return True
    end = last.rstrip("*_ \t")
    if not end:
        return False
    if end.endswith(("...", "…")):
        return len(WORD.findall(t)) > 0
    if end[-1] in ".!?\"”»)":
        return False
    if end[-1] in ",;–—-":
        return True
    if ITEM.match(last):
        return False
    return len(WORD.findall(t)) > few or end[-1] == ":"


def is_wrong_language(question: str, answer: str, margin: float = 1.5, least: float = 2.0) -> bool:
    """Stopword votes: the answer is for the most part in another language than the question and than the one asked for."""
    vq, va = votes(question), votes(CITATIONS.sub(" ", answer))
    lq, la = max(vq, key=vq.get), max(va, key=va.get)
    if lq == la or vq[lq] <= 0 or va[la] < least or va[la] < margin * va[lq] or vq[lq] < 1.2 * vq[la]:
        return False
    asked = {NAME_TO_CODE[x] for x in LANGUAGE_ASKED.findall(question.lower())}
    return la not in asked and la in CODES


def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    courtesy, asked = _automaton(COURTESY), _automaton(ASKED)
    for pdf in frames:
        kinds = []
        for q, a in zip(pdf["question"], pdf["answer"], strict=True):
            q = q if isinstance(q, str) else ""
            a = a if isinstance(a, str) else None
            if is_empty(a):
                kinds.append("empty")
            elif is_refusal(a, courtesy, asked):
                kinds.append("refusal")
            elif is_echo(q, a):
                kinds.append("echo")
            elif is_truncated(a):
                kinds.append("truncated")
            elif is_wrong_language(q, a):
                kinds.append("wrong_language")
            else:
                kinds.append(None)
        yield pd.DataFrame({"id": pdf["id"], "defect": kinds})


def defects(conversations: DataFrame) -> DataFrame:
    """(id, defect) of every pair with a defective answer; one row per id."""
    rows = conversations.filter("id IS NOT NULL").select("id", "question", "answer").mapInPandas(judge, "id bigint, defect string")
    order = F.expr("CASE defect " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(DEFECTS)) + " END")
    return rows.filter("defect IS NOT NULL").groupBy("id").agg(F.min_by("defect", order).alias("defect"))
