"""Abusive, hateful or sexual content by multiple-instance learning.

A document is a bag of sentences. A sentence has cue features (which kinds of cue it holds, and which of them
together) and its own words and word pairs, hashed. A logistic score per category gives each sentence a
probability; a noisy-or over sentences and categories gives the document's. The weights start from a prior on
the cues and from the words and word pairs that the labels mark beyond chance where no cue explains the label; they
are trained from document labels only, on at most ``max_labelled`` documents, so that the model is small and fits
the driver; the scoring is a narrow map over all documents and whole texts. Every sentence counts in training and
scoring; one without any cue starts low enough that length alone flags no text, and counts for its likeliest
category only, as document labels don't name one.

Disguises are undone first: look-alike letters, invisible characters, digits for letters, letters repeated,
spaced, dotted or starred out.

Nulls: a null id gives no row, a null or empty text scores 0. Contradicting labels count by their mean, null
labels not at all; without labels the prior is used as it is. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import mix, one_kind, repair, without_marks, word_hashes

CATEGORIES = ("abusive", "hateful", "sexual")

# Cues by kind, in four languages, lower case without accents. They are common words of abuse, no names of groups but
# those that hate commonly meets, and each is only a feature of the sentence that holds it.
CUES = {
    "insult": [
        "idiot", "idiots", "moron", "morons", "cretin", "cretins", "pig", "scumbag", "scum", "halfwit", "bastard", "asshole", "parasite", "imbecile", "fool", "loser", "dumbass", "bitch", "coward", "no brain", "dimwit", "freak", "jerk", "twat", "prick", "dickhead", "whore", "slut",
        "worthless", "pathetic", "brainless", "spineless", "stinking", "filthy", "miserable", "disgusting", "stupid", "ugly", "hideous", "big mouth", "useless", "vile", "dumb", "just a n", "clown", "trash", "garbage",
        "connard", "connasse", "salaud", "salope", "ordure", "abruti", "debile", "ignoble", "repugnant", "stupide", "pauvre con", "enfoire", "minable", "encule", "batard", "cretine", "moche",
        "dummkopf", "trottel", "drecksack", "mistkerl", "arsch", "arschloch", "elender", "elende", "widerlicher", "widerliche", "hirnloser", "erbarmlicher", "dreckiger", "vollidiot", "depp", "schwein", "wichser", "hurensohn", "missgeburt", "hassliche", "hasslicher",
        "idiota", "imbecil", "cretino", "cabron", "gilipollas", "cerdo", "patetico", "inutil", "asqueroso", "repugnante", "estupido", "tonto", "sucio", "hijo de puta", "basura", "payaso", "feo",
    ],
    "violence": [
        "smash", "crush", "burn", "break your", "cut up", "cut you", "kill you", "beat you", "hurt you", "tear you", "strangle", "stab", "punch", "shoot you", "slit", "skin you", "bash",
        "casser", "tuer", "crever", "frapper", "egorger", "etrangler", "schlage dir", "schlage dich", "bring dich um", "mach dich fertig", "umbringen", "erwurgen", "abstechen",
        "partir la cara", "romper la cara", "matar", "golpear", "apunalar", "reventar",
    ],
    "body": [
        "skull", "jaw", "teeth", "your face", "ugly face", "kneecaps", "throat", "neck", "bones", "figure", "gueule", "machoire", "dents", "zahne", "fresse", "schadel", "knochen", "kiefer", "cara", "dientes", "cuello", "huesos", "mandibula",
    ],
    "intent": [
        "i will", "i am going to", "i swear", "somebody should", "someone should", "i am coming", "i shall", "i ll", "gonna", "wait until", "watch your back", "je vais", "je jure", "on devrait", "quelqu un devrait", "ich werde", "ich schwore", "jemand sollte", "warte nur", "voy a", "te juro", "alguien deberia",
    ],
    "threat": [
        "where you live", "come for you", "coming for you", "find you and", "ou tu habites", "ou vous habitez", "wo du wohnst", "donde vives", "te voy a matar", "bring dich um", "te tuer", "kill you",
    ],
    "silence": [
        "shut your mouth", "shut up", "get lost", "die in a ditch", "you choke", "hope you die", "drop dead", "go to hell", "nobody asked you", "ashamed of such", "nobody would miss", "hang yourself", "kill yourself", "go die", "crawl back", "rot in hell", "burn in hell", "you make me sick", "fuck off", "piss off",
        "ferme ta gueule", "ta gueule", "vas crever", "tu creves", "va mourir", "casse-toi", "degage", "pends-toi", "va te faire", "halt dein maul", "halt die fresse", "dein maul", "verreckst", "verpiss dich", "hang dich auf", "bring dich um", "fahr zur holle",
        "cierra la boca", "callate", "te mueras", "vete al diablo", "vete a la mierda", "muerete", "ahorcate", "matate", "que te jodan",
    ],
    "group": [
        "immigrants", "foreigners", "refugees", "migrants", "believers", "unbelievers", "cripples", "old people", "women", "men like", "disabled people", "these people", "those people", "their kind", "that race", "their race", "jews", "muslims", "christians", "gays", "blacks", "gypsies",
        "etrangers", "immigres", "refugies", "vieux", "infirmes", "femmes", "croyants", "ces gens", "cette race", "juifs", "musulmans", "auslander", "einwanderer", "fluchtlinge", "kruppel", "alten", "frauen", "glaubigen", "migranten", "dieses volk", "juden", "muslime", "zigeuner",
        "extranjeros", "inmigrantes", "refugiados", "viejos", "lisiados", "mujeres", "creyentes", "esa gente", "esa raza", "judios", "musulmanes", "gitanos",
    ],
    "plural": [
        "are", "they", "them", "those", "these", "all", "their", "people", "belong", "sind", "alle", "ihnen", "sie", "vermehren", "verdienen", "sont", "les", "ces", "ils", "elles", "tous", "meritent", "son", "los", "las", "esos", "ellos", "todos", "merecen", "do not deserve", "don t deserve",
    ],
    "verdict": [
        "ought to be", "should be", "must be", "have to be", "need to be", "il faut", "faut", "doivent etre", "gehoren", "sollte man", "muss man", "mussen", "hay que", "deberian ser", "deben ser",
    ],
    "degrade": [
        "vermin", "breed like", "to breed", "like rats", "like animals", "in cages", "lice", "lower than", "less than animals", "than animals", "than dogs", "than rats", "filth", "by nature", "born thieves", "born liars", "born criminals", "a disease", "a plague", "a cancer", "savages", "subhuman", "subhumans", "inferior", "cockroaches", "parasites", "are animals", "belong in", "breed", "dirt", "decent people", "honest people", "cannot trust", "can not trust", "no peace here", "dirty",
        "vermine", "comme des rats", "par nature", "nuisibles", "sauvages", "sous-hommes", "une maladie", "un fleau", "meritent pas", "faire confiance", "se reproduisent", "gens honnetes", "sales", "ungeziefer", "wie ratten", "von natur aus", "nie trauen", "untermenschen", "keine medizin", "eine plage", "eine seuche", "wilde", "abschaum", "schmarotzer", "vermehren sich", "dreck", "dreckig", "anstandige leute", "minderwertig",
        "una plaga", "como ratas", "por naturaleza", "no te fies", "alimanas", "salvajes", "escoria", "una enfermedad", "infrahumanos", "no merecen", "se reproducen", "mugre", "gente decente", "sucios", "inferiores",
    ],
    "remove": [
        "wiped out", "wipe out", "wipe them", "sterilised", "sterilized", "driven out", "drive them out", "beaten out", "let them rot", "ship them", "round up", "exterminated", "exterminate", "eradicated", "eradicate", "deported", "deport them", "expelled", "locked up", "get rid of", "gassed", "should refuse them", "deserve medicine", "nobody wants", "go back to where", "came here to",
        "faut chasser", "exterminer", "expulser", "eliminer", "renvoyer chez", "se debarrasser", "stériliser", "vertrieben", "vertreiben", "ausrotten", "ausgerottet", "abschieben", "rauswerfen", "wegsperren", "vergasen", "niemand will",
        "que echarlos", "echarlos", "exterminar", "exterminarlos", "expulsar", "deportar", "eliminar a", "nadie quiere", "encerrarlos",
    ],
    "sexual": [
        "cock", "horny", "slutty", "naked", "hardcore", "xxx", "dripping", "singles", "strip", "strip live", "on cam", "adult girls", "moaning", "moaned", "spread her legs", "thrust", "thrust into", "inside her", "inside him", "mature couples", "his cock", "climaxed", "climax", "aroused", "erection", "free trial", "no signup", "the profile",
        "in her mouth", "her mouth", "pulled off his trousers", "took off her", "wet", "screamed", "pussy", "tits", "cum", "nude", "escort", "nipples", "licked", "lick you", "feel you come", "make you come", "inside you", "touch yourself", "all over you", "you all over", "deep throat", "anal", "orgy", "sexy",
        "sa queue", "queue", "en gemissant", "gemissant", "arracha le pantalon", "femmes nues", "nue", "nues", "coquines", "chaudes", "en direct ce soir", "spectacle", "celibataires", "le profil", "salopes", "ses seins", "penetra", "jouit", "sans inscription",
        "seinen schwanz", "schwanz", "stohnend", "stohnte", "riss ihm die hose", "nackt", "nackte", "versaute", "geile", "geil", "heute live", "vor der kamera", "ohne anmeldung", "das profil", "in den mund", "in sie ein", "ihre bruste",
        "su polla", "polla", "gimiendo", "bajo el pantalon", "en la boca", "desnuda", "desnudas", "guarras", "calientes", "cachonda", "cachondas", "solteras", "en directo", "sin registro", "mira mujeres", "en el perfil", "sus tetas", "penetro", "se corrio",
    ],
    "porn": ["porn", "porno", "pornos", "pornographic videos", "fuck", "fucking", "fucked", "ficken", "fickte", "follar", "baiser", "blowjob", "handjob", "gangbang", "sex chat", "sex cam", "sexcam"],
    "medical": [
        "study", "studies", "patients", "patient", "tissue", "hormone", "hormones", "estrogen", "prolactin", "testosterone", "progesterone", "menopause", "libido", "symptoms", "infection", "bacteria", "clinical", "treatment", "textbook", "embryonic", "dryness", "gland", "orgasm", "anatomy",
        "etude", "patientes", "oestrogene", "vaginale", "secheresse", "traitement", "symptomes", "studie", "patientinnen", "patienten", "ostrogen", "trockenheit", "scheidentrockenheit", "beschwerden", "behandlung", "estudio", "pacientes", "estrogeno", "sequedad", "sintomas", "tratamiento",
    ],
    "condemn": [
        "wrong and cruel", "cruel to say", "nobody should call", "no one should call", "words do damage", "do damage", "wrong to say", "wrong to call", "must not say", "must not call", "should not say", "should not call", "no one should say", "hurtful", "offensive", "slur", "unacceptable to", "condemn", "racist to", "an insult to", "never call",
        "il est cruel", "cruel de dire", "faux de dire", "honteux de dire", "inacceptable", "personne ne devrait", "grausam zu sagen", "falsch zu sagen", "falsch zu behaupten", "niemand sollte", "beleidigend", "es cruel", "cruel decir", "falso decir", "nadie deberia llamar", "inaceptable", "ofensivo",
    ],
    "self": ["i was", "i am", "i felt", "i feel", "my own", "me an", "myself", "j ai ete", "je suis", "j etais", "quel idiot", "moi-meme", "ich war", "ich bin", "ich selbst", "fui", "soy un", "yo mismo", "me senti", "taught me"],
    "typical": ["typical", "tipico", "typisch", "typique"],
}
ADDRESS = set("you your yours youre u tu te toi ta ton tes vous votre vos du dich dir dein deine deinen deinem ti eres tus usted ustedes vosotros os vas sais".split())
KINDS = tuple(CUES)
KIND_OF: dict[str, tuple[str, ...]] = {}
for _k, _terms in CUES.items():
    for _t in _terms:
        KIND_OF[_t] = (*KIND_OF.get(_t, ()), _k)
SINGLE = {t for t in KIND_OF if " " not in t} | {w for t in KIND_OF for w in t.split() if len(w) > 3}
BY_SHAPE: dict[int, list[str]] = {}
for _t in sorted(SINGLE, key=lambda t: (t not in KIND_OF, t)):
    BY_SHAPE.setdefault(len(_t), []).append(_t)

# Named features of a sentence, and the prior weight of each for each category.
FEATURES = [
    "bias", "plain", *KINDS, "address", "insult+address", "insult twice", "insult+self", "violence+address", "body+violence", "intent+violence", "intent+violence+address", "verdict+remove", "typical+insult", "degrade+plural", "remove+plural", "group+degrade", "group+remove",
    "degrade+remove", "two degrades", "two removes", "two sexual", "three sexual", "sexual+porn", "medical twice",
]
AT = {f: i for i, f in enumerate(FEATURES)}
HASHED = 1 << 18
PRIOR = {
    "abusive": {
        "bias": -4.0, "plain": -8.0, "insult+address": 6.0, "violence+address": 1.0, "body+violence": 1.8, "intent+violence": 2.4, "intent+violence+address": 2.0, "threat": 6.0, "silence": 6.0, "insult": 0.7, "insult twice": 1.0, "typical+insult": 3.0, "condemn": -6.0, "insult+self": -5.0, "medical": -2.0, "degrade": -1.0,
    },
    "hateful": {
        "bias": -4.0, "plain": -8.0, "degrade": 1.6, "remove": 1.4, "degrade+plural": 1.2, "remove+plural": 0.8, "verdict+remove": 3.2, "group+degrade": 3.0, "group+remove": 3.0, "degrade+remove": 2.5, "two degrades": 2.6, "two removes": 2.0, "condemn": -9.0, "medical": -1.5, "insult+self": -3.0,
    },
    "sexual": {"bias": -4.0, "plain": -8.0, "porn": 5.5, "sexual": 1.2, "two sexual": 3.4, "three sexual": 2.0, "sexual+porn": 3.0, "medical": -3.0, "medical twice": -3.0, "condemn": -3.0},
}

LOOKALIKE = str.maketrans("аеорсухіјѕԁӏɡνοαερτικ", "aeopcyxijsdlgvoaeptik")
_FOREIGN = re.compile("[Ͱ-ӿԀ-ԯɡ]")
_LEET = re.compile(r"(?<![\w@$])(?=[\w@$!]{3,16}(?![\w@$]))(?=[\w@$!]*[a-z])[\w@$!]*[0-9@$!][\w@$!]*")
_HASDIGIT = re.compile(r"[0-9@$][a-z]|[a-z][0-9@$]")
_LEET_MAPS = [str.maketrans("01345789@$!", "oieasstgasi"), str.maketrans("01345789@$!", "oleasbtgasl"), str.maketrans("01345789@$!", "oieastbgasi"), str.maketrans("01345789@$!", "oieastgbasi")]
_TRIPLE = re.compile(r"\b(?=\w{4,40}\b)\w*?([a-z])\1\1\w*")
_TRIPLES = tuple(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
_SPACED = re.compile(r"(?<![^\W_])(?:[a-z][ .\-_*]){2,}[a-z](?![^\W_])")
_STARRED = re.compile(r"(?<![\w*])[a-z]+\*+[a-z*]*[a-z](?![\w*])")
_END = re.compile(r"(?:[!?…]|(?<![\s.\-_*][^\W\d_])\.)[.!?…]*(?=[\s\"'”»)\]]|$)|\n[^\S\n]*\n|\r\n[^\S\n]*\r\n")  # the point of a single letter, as in a word spelt out, is none
_SEP = "\x01"
_WORD = re.compile(r"[^\W_]+")


def _star(m: re.Match) -> str:
    t = m.group(0)
    pattern = re.compile(t.replace("*", "[a-z]"))
    return next((w for w in BY_SHAPE.get(len(t), ()) if pattern.fullmatch(w)), t)


def _leet(m: re.Match) -> str:
    t = m.group(0)
    for table in _LEET_MAPS:
        for w in (t.translate(table), t.rstrip("!").translate(table)):
            if w in SINGLE:
                return w
            w = re.sub(r"([a-z])\1{2,}", r"\1", w)
            if w in SINGLE:
                return w
    return t


def _triple(m: re.Match) -> str:
    t = m.group(0)
    if t in SINGLE:
        return t
    for by in (r"\1", r"\1\1"):
        w = re.sub(r"([a-z])\1{2,}", by, t)
        if w in SINGLE:
            return w
    return re.sub(r"([a-z])\1{2,}", r"\1", t)


def _joined(m: re.Match) -> str:
    raw = m.group(0)
    t = re.sub(r"[ .\-_*]", "", raw)
    if t in SINGLE:
        return t
    # several words in one run of letters: take known words out, the longest first, if little else is left
    rest, found = t, []
    while best := max((w for w in SINGLE if len(w) >= 4 and w in rest), key=len, default=""):
        found.append(best)
        rest = rest.replace(best, " ", 1)
    if found and len(rest.replace(" ", "")) <= 2:
        return " ".join(sorted(found, key=t.index) + rest.split())
    return raw


def normal(text: str) -> str:
    """Lower case without accents, disguises undone."""
    t = repair(text).lower()
    if not t.isascii():
        if _FOREIGN.search(t):
            t = t.translate(LOOKALIKE)
        t = without_marks(t).replace("ß", "ss").replace("œ", "oe")
    if "*" in t:
        t = t.replace("**", "") if t.count("**") > 3 and not _STARRED.search(t) else t
        t = _STARRED.sub(_star, t)
    if _HASDIGIT.search(t):
        t = _LEET.sub(_leet, t)
    if any(x in t for x in _TRIPLES):
        t = _TRIPLE.sub(_triple, t)
    return _SPACED.sub(_joined, t)


# Kinds that mark a sentence; the others only tell something beside one of these.
MAIN = frozenset(("insult", "violence", "threat", "silence", "degrade", "remove", "sexual", "porn"))


def automaton(main: bool = True):
    """The cues of the kinds that mark a sentence, or the others."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, kinds in KIND_OF.items():
        own = tuple(k for k in kinds if (k in MAIN) == main)
        if own:
            a.add_word(term, (len(term), own))
    a.make_automaton()
    return a


@cache
def _beside():
    return automaton(main=False)


def _hits(finder, t: str) -> Iterator[tuple[int, tuple[str, ...]]]:
    for end, (size, kinds) in finder.iter(t):
        a, b = end - size + 1, end + 1
        if (a == 0 or not t[a - 1].isalnum()) and (b == len(t) or not t[b].isalnum()):
            yield a, kinds


def sentences(text: str, finder) -> list[tuple[int, int, str, dict[str, set[int]]]]:
    """(start, end, normalised sentence, cues by kind) of each sentence that is not blank; the places are those in the text as it was given."""
    text = text.replace(_SEP, " ")
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    spans = list(zip([0, *ends], ends, strict=False))
    whole = normal(_SEP.join(text[a:b] for a, b in spans))
    parts = whole.split(_SEP)
    if len(parts) != len(spans):  # something in the text became a separator
        parts = [normal(text[a:b]).replace(_SEP, " ") for a, b in spans]
        whole = _SEP.join(parts)
    cues: dict[int, dict[str, set[int]]] = {}
    begins: list[int] = []
    for a, kinds in _hits(finder, whole):
        if not begins:
            begins = np.cumsum([0, *(len(p) + 1 for p in parts)]).tolist()
        own = cues.setdefault(bisect.bisect_right(begins, a) - 1, {})
        for k in kinds:
            own.setdefault(k, set()).add(a)
    for i, own in cues.items():
        for a, kinds in _hits(_beside(), parts[i]):
            for k in kinds:
                own.setdefault(k, set()).add(a)
    return [(a, b, p, cues.get(i, {})) for i, ((a, b), p) in enumerate(zip(spans, parts, strict=True)) if p.strip()]


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the sentence, hashed word or word pair), once each and in order, of normalised sentences."""
    size, h = word_hashes(parts)
    at = np.repeat(np.arange(len(parts)), size)
    inside = at[1:] == at[:-1]
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[inside]
    code = (np.concatenate([h, pair]) >> np.uint64(40)).astype(np.int64) % HASHED
    key = np.sort(np.concatenate([at, at[1:][inside]]) * HASHED + code)
    key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
    return key // HASHED, key % HASHED


def named_features(sentence: str, cues: dict[str, set[int]]) -> list[int]:
    """Named features of a sentence: its cues, and which of them together."""
    if not cues:
        return [AT["bias"], AT["plain"]]
    n = {k: len(v) for k, v in cues.items()}
    on = ["bias", *cues]
    both = [("violence", "body", "body+violence"), ("violence", "intent", "intent+violence"), ("typical", "insult", "typical+insult"), ("degrade", "plural", "degrade+plural"), ("remove", "plural", "remove+plural"), ("verdict", "remove", "verdict+remove"),
            ("group", "degrade", "group+degrade"), ("group", "remove", "group+remove"), ("degrade", "remove", "degrade+remove"), ("sexual", "porn", "sexual+porn")]
    on += [f for a, b, f in both if a in n and b in n]
    if not ADDRESS.isdisjoint(_WORD.findall(sentence)):
        on.append("address")
        on += [f"{k}+address" for k in ("insult", "violence") if k in n]
        if "violence" in n and "intent" in n:
            on.append("intent+violence+address")
    elif "insult" in n and "self" in n:
        on.append("insult+self")
    on += [f for k, least, f in (("insult", 2, "insult twice"), ("degrade", 2, "two degrades"), ("remove", 2, "two removes"), ("sexual", 2, "two sexual"), ("sexual", 3, "three sexual"), ("medical", 2, "medical twice")) if n.get(k, 0) >= least]
    return [AT[f] for f in on]


def features(sentence: str, cues: dict[str, set[int]]) -> tuple[list[int], list[int]]:
    """Named features and hashed words and word pairs of a sentence."""
    return named_features(sentence, cues), grams([sentence])[1].tolist()


def prior() -> np.ndarray:
    w = np.zeros((len(CATEGORIES), len(FEATURES) + HASHED))
    for c, name in enumerate(CATEGORIES):
        for f, x in PRIOR[name].items():
            w[c, AT[f]] = x
    return w


def _tail(k: int, n: int, r: float) -> float:
    """Chance of ``k`` or more of ``n`` at rate ``r``."""
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(r) + (n - i) * math.log1p(-r)) for i in range(k, n + 1))


def _marked(gram: np.ndarray, bag: np.ndarray, y: np.ndarray, open_: np.ndarray, size: int, flip: float, wrong: float = 0.05, most: float = 8.0) -> np.ndarray:
    """Start weight of each word and word pair: the log-likelihood ratio of the labels of its documents if it is toxic and if
    it is not, where the labels mark it beyond chance (at most a share ``wrong`` of the marked ones by chance, after
    Benjamini and Hochberg; those of the same documents are one case), else zero. ``open_`` is the share of each
    document's label that its cues leave unexplained; no weight exceeds ``most``, so that one word alone makes no sentence toxic."""
    key = np.unique(gram.astype(np.int64) * len(y) + bag)
    gram, bag = key // len(y), key % len(y)
    for_ = np.bincount(gram, (open_ * y)[bag], size)
    against = np.bincount(gram, (1 - y)[bag], size)
    r = float((open_ * y).sum() / max(1e-9, (open_ * y + 1 - y).sum()))
    r = min(max(r, flip), 0.5)
    ratio = for_ * np.log((1 - flip) / r) + against * np.log(flip / (1 - r))
    several = np.flatnonzero(np.bincount(gram, minlength=size) > 1)
    _, case = np.unique(np.bincount(gram, np.random.default_rng(0).random(len(y))[bag], size)[several].round(9), return_inverse=True)
    chance = np.ones(size)
    for g in several[ratio[several] > 0]:
        k, n = int(for_[g] + 0.05), int(np.ceil(for_[g] + against[g] - 0.05))
        chance[g] = _tail(k, n, r)
    each = np.ones(case.max(initial=-1) + 1)
    np.minimum.at(each, case, chance[several])
    ranked = np.sort(each)
    good = ranked[ranked <= wrong * np.arange(1, len(ranked) + 1) / len(ranked)]
    return np.where(chance <= (good[-1] if len(good) else -1.0), np.minimum(ratio, most), 0.0)


def train(bags: list[tuple[list[tuple[list[int], list[int]]], float]], rounds: int = 150, rate: float = 0.5, hold: float = 0.02, flip: float = 0.05) -> np.ndarray:
    """Noisy-or multiple-instance learning: ascent on the likelihood of the document labels, held to the start.

    ``bags`` has the sentences (named features, hashed features) and the label of each document; they are kept as
    sparse rows, equal sentences once. ``flip`` is the share of labels taken to be wrong, ``hold`` the pull back to the start.
    """
    start = prior()
    bags = [(x, y) for x, y in bags if x]
    if not bags:
        return start
    known: dict[tuple[bytes, bytes], int] = {}
    member, bag = [], []  # sentence and document of each occurrence
    for b, (own, _) in enumerate(bags):
        for named, hashed in own:
            key = np.asarray(named, dtype=np.int32).tobytes(), np.asarray(hashed, dtype=np.int32).tobytes()
            member.append(known.setdefault(key, len(known)))
            bag.append(b)
    member, bag = np.array(member, dtype=np.int32), np.array(bag, dtype=np.int32)
    y = np.array([label for _, label in bags])
    sizes = np.array([(len(n) // 4, len(h) // 4) for n, h in known])  # named and hashed features of each sentence
    at = np.concatenate([x for n, h in known for x in (np.frombuffer(n, np.int32), np.frombuffer(h, np.int32) + len(FEATURES))])
    value = np.repeat(np.stack([np.ones(len(known)), np.maximum(1, sizes[:, 1]) ** -0.5], axis=1).ravel(), sizes.ravel())
    row = np.repeat(np.arange(len(known)), sizes.sum(axis=1))
    # a word of one document only tells nothing of others: it keeps its start
    often = np.bincount(at, np.bincount(member, minlength=len(known))[row], start.shape[1]) > 1
    often[: len(FEATURES)] = True
    row, value, at = row[often[at]], value[often[at]], at[often[at]]
    used, at = np.unique(at, return_inverse=True)
    w0 = start[:, used]
    # runs of one value in a sentence, its named and its hashed features: the value is applied once a run
    new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]
    begin = np.flatnonzero(new)
    run_row, run_value = row[begin], value[begin]
    by_feature = np.argsort(at, kind="stable")
    run_of = (np.cumsum(new) - 1)[by_feature]
    first_of = np.searchsorted(at[by_feature], np.arange(len(used)))
    space = np.empty(len(at))

    def sums(x: np.ndarray, of: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.take(x, of, out=space, mode="clip"), begin)

    def chances(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.stack([np.bincount(run_row, sums(own, at, begin) * run_value, len(known)) for own in w], axis=1)
        p = 1.0 / (1.0 + np.exp(-z))
        none = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)).sum(axis=1)[member], len(bags))
        return p, 1.0 - np.exp(none)  # that the bag holds something

    # words and word pairs of sentences without a cue that the labels mark
    plain = np.zeros(len(known), dtype=bool)
    plain[row[used[at] == AT["plain"]]] = True
    order = np.argsort(member, kind="stable")
    spread = np.bincount(member, minlength=len(known))
    mine = plain[row] & (used[at] >= len(FEATURES))
    first = np.r_[0, np.cumsum(spread)]
    each = spread[row[mine]]
    gram = np.repeat(at[mine], each)
    place = np.repeat(first[row[mine]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    w0 = w0 + _marked(gram, bag[order][place], y, 1.0 - chances(w0)[1], len(used), flip)
    w = w0.copy()
    for _ in range(rounds):
        p, q = chances(w)
        seen = flip + (1 - 2 * flip) * q
        slope = (y / seen - (1 - y) / (1 - seen)) * (1 - 2 * flip) * (1 - q)
        step = np.bincount(member, slope[bag], len(known)) * p.T
        grad = np.stack([sums(own[run_row] * run_value, run_of, first_of) for own in step]) / max(200, len(bags))  # few labels move the prior little
        w += rate * (grad * 10 - hold * (w - w0))
    start[:, used] = w
    return start


def _bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features of all sentences of labelled documents, packed."""
    finder = automaton()
    for pdf in frames:
        rows = []
        for i, t, y in zip(pdf["doc_id"], pdf["text"], pdf["toxic"], strict=True):
            if isinstance(t, str) and t:
                found = sentences(t, finder)
                at, code = grams([s for _, _, s, _ in found])
                hashed = np.split(code.astype(np.int32), np.searchsorted(at, np.arange(1, len(found))))
                rows += [(i, float(y), np.array(named_features(s, cues), np.int32).tobytes(), h.tobytes()) for (_, _, s, cues), h in zip(found, hashed, strict=False)]
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "named", "hashed"])


def learn(documents: DataFrame, labels: DataFrame, max_labelled: int = 4000) -> np.ndarray:
    """Weights from the labels of at most ``max_labelled`` documents, chosen by a hash of the id, and all their sentences.

    This bound is the one sample in the operator; the rows that reach the driver are packed feature numbers of the
    sentences of those documents.
    """
    mean = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    sample = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInPandas(_bags, "doc_id bigint, toxic double, named binary, hashed binary").collect()
    bags: dict[int, tuple[list[tuple[np.ndarray, np.ndarray]], float]] = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.named, r.hashed)):
        bags.setdefault(r.doc_id, ([], r.toxic))[0].append((np.frombuffer(r.named, np.int32), np.frombuffer(r.hashed, np.int32)))
    return train(list(bags.values()))


def sentence_scores(found: list[tuple[int, int, str, dict[str, set[int]]]], weights: np.ndarray) -> np.ndarray:
    """Probability of each sentence (row) for each category."""
    at, gram = grams([s for _, _, s, _ in found])
    size = np.sqrt(np.maximum(1, np.bincount(at, minlength=len(found))))
    z = np.stack([np.bincount(at, w[gram + len(FEATURES)], len(found)) / size for w in weights], axis=1)
    z += weights[:, [AT["bias"], AT["plain"]]].sum(axis=1)
    for i, (_, _, s, cues) in enumerate(found):
        if cues:
            z[i] += weights[:, named_features(s, cues)].sum(axis=1) - weights[:, [AT["bias"], AT["plain"]]].sum(axis=1)
    p = 1.0 / (1.0 + np.exp(-z))
    plain = np.array([not cues for *_, cues in found], dtype=bool)
    likeliest = np.arange(len(CATEGORIES)) == z.argmax(axis=1)[:, None]  # the first of equal ones
    return np.where(plain[:, None] & ~likeliest, 0.0, p)


def _score(weights: np.ndarray, batch_chars: int = 1_000_000):
    def scored(ids: list, each: list[list]) -> pd.DataFrame:
        found = [x for own in each for x in own]
        p = sentence_scores(found, weights) if found else np.zeros((0, len(CATEGORIES)))
        out, at = [], 0
        for i, own in zip(ids, each, strict=True):
            q = p[at : at + len(own)]
            at += len(own)
            worst = [own[k][:2] if q[k, c] > 0 else (-1, -1) for c, k in enumerate(q.argmax(axis=0))] if len(own) else [(-1, -1)] * len(CATEGORIES)
            out.append((i, *(1.0 - np.prod(1.0 - q, axis=0)).tolist(), *(int(x) for c in worst for x in c)))
        return pd.DataFrame(out, columns=["doc_id", *CATEGORIES, *(f"{c}_{e}" for c in CATEGORIES for e in ("from", "to"))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = automaton()
        for pdf in frames:
            ids, each, chars = [], [], 0
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids.append(i)
                each.append(sentences(t, finder) if isinstance(t, str) and t else [])
                chars += len(t) if isinstance(t, str) else 0
                if chars >= batch_chars:
                    yield scored(ids, each)
                    ids, each, chars = [], [], 0
            yield scored(ids, each)

    return run


def scores(documents: DataFrame, labels: DataFrame, max_labelled: int = 4000) -> DataFrame:
    """(doc_id, abusive, hateful, sexual, and from/to of the worst sentence of each, as places in the text)."""
    weights = learn(documents, labels, max_labelled)
    schema = "doc_id bigint, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", " + ", ".join(f"{c}_from int, {c}_to int" for c in CATEGORIES)
    return documents.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(_score(weights), schema)


def flagged(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, category) of each category whose score reaches the threshold."""
    kinds = F.array(*[F.when(F.col(c) >= threshold, F.lit(c)) for c in CATEGORIES])
    return scored.select("doc_id", F.explode(F.array_compact(kinds)).alias("category")).distinct()


def rates(documents: DataFrame, scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents, flagged documents and mean scores per source in one spelling."""
    source = documents.select("doc_id", F.coalesce(one_kind(F.col("source")), F.lit("unknown")).alias("source"))
    any_ = F.greatest(*CATEGORIES) >= threshold
    return source.join(scored, "doc_id").groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if(any_).alias("flagged"),
        F.round(F.avg(any_.cast("int")), 6).alias("flagged_rate"),
        *[F.count_if(F.col(c) >= threshold).alias(c) for c in CATEGORIES],
        *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in CATEGORIES],
    )
