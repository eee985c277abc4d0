"""Refusals: an automaton of parts over words, and rules on which parts must follow each other.

A sentence declines if it holds the parts of a rule in order, each at most a few words after the one before. Parts are
function words and verbs of speech in four languages, so that a refusal is known by how it is built, and "unable to agree" is none.
"""

from __future__ import annotations

import re
from functools import cache

WORD = re.compile(r"[^\W_]+")
_SHORT = [(re.compile(p), r) for p, r in ((r"\bcan't\b|\bcannot\b", "can not"), (r"\bwon't\b", "will not"), (r"n't\b", " not"), (r"\bi'm\b", "i am"), (r"'re\b", " are"), (r"'ve\b", " have"), (r"'d\b", " would"), (r"'ll\b", " will"))]

# Parts by kind, folded to lower case without accents, contractions spelt out.
PARTS = {
    # English
    "self": "i|we|this assistant|the assistant|me",
    "negated": (
        "can not|could not|will not|would not|may not|must not|should not|do not wish to|do not want to|do not feel able to|unable to|not able to|not allowed to|not permitted to|not in a position to|"
        "not qualified to|not going to|not prepared to|not willing to|unwilling to|not comfortable|rather not|prefer not to|prefer to not|not free to|never|not at liberty to|refuse to|decline to|not authorised to|not authorized to|not supposed to"
    ),
    "say": (
        "answer|answering|advise|advising|comment|commenting|discuss|discussing|help|helping|assist|assisting|respond|responding|reply|speak|talk|provide|offer|give advice|give you|give an answer|give any|give guidance|give opinions|give an opinion|"
        "share|go into|address|weigh in|engage|speculate|guess|express|judge|tell you|say anything|say more|say whether|say much|do that|do this|fulfil|fulfill|comply|make a statement|offer guidance|take a position|make recommendations|get into|touch on"
    ),
    "find": "locate|find|identify|retrieve|see",
    "anything": "anything|any|information|material|passage|passages|source|sources|document|documents|answer|enough|nothing",
    "decline": "decline|respectfully decline|abstain from|must refuse|have to refuse|must pass|have to pass on|will pass on|stay away from|keep away from|steer clear of|refuse",
    "left to others": "asked to leave|leave that to|leave this to|leave it to|irresponsible of me|not my place|look elsewhere|ask elsewhere|not for me to",
    "sources": "passage|passages|source|sources|document|documents|material|materials|corpus|archive|archives|text|texts|excerpt|excerpts|evidence|record|records|index|notes|context|search|results|collection|library|database|data",
    "not": "not|no|nothing|none|neither|silent|thin|insufficient|fail to|fails to|lack|lacks|without|hardly any",
    "cover": "cover|covers|address|addresses|discuss|discusses|deal with|deals with|touch on|touches on|speak about|speaks about|speak of|say|says|talk about|treat|contain|contains|came close|come close|answer|answers|enough|on hand|silent|thin|available|speaks to|speak to|found|match|matches|relevant",
    "no basis": "no reliable basis|no sound basis|no basis|no information|no relevant|no matching|no suitable|not enough information|not enough evidence|not enough material|not enough context|insufficient information|insufficient evidence|insufficient data|insufficient context|too little information|too little material",
    "no reply": "no reply|no answer is|no answer can|no answer could|not be answered|no comment|goes unanswered|remains unanswered|no response can|not possible to answer|impossible to answer|impossible to say|not possible to say",
    "beyond": "outside|beyond|out of|exceeds",
    "remit": "my knowledge|my scope|my remit|my expertise|my competence|my abilities|the scope|what i|my field|my reach|what we|my training|me",
    "machine": "as an ai|as a language model|as an ai language model|as an assistant|as a virtual assistant|as a chatbot",
    "do not": "do not|can not|am not|not able|unable|have no|will not|may not",
    "know": "do not know|no idea|have no knowledge|have no data|have no information|can not say|could not say|not know",
    # French
    "je": "je|nous|j",
    "ne pas": "ne peux pas|ne peux|ne pouvons pas|ne souhaitons pas|ne voulons pas|preferons ne pas|ne sommes pas en mesure de|refusons de|ne puis|ne saurais|ne suis pas en mesure de|ne suis pas autorise a|ne suis pas habilite a|ne souhaite pas|ne veux pas|ne dois pas|prefere ne pas|prefere ne rien|refuse de|ne vais pas|m abstiens de|ne me permets pas de|n ai pas le droit de|ne suis pas capable de",
    "dire": "repondre|conseiller|aider|dire|commenter|discuter|prononcer|donner|traiter|parler|renseigner|informer|exprimer|juger|avis|trouver|me prononcer",
    "decliner": "dois decliner|dois refuser|decline cette|decline votre|je refuse|je m abstiens|je passe mon tour",
    "fonds": "passages|passage|sources|source|textes|documents|fonds|archive|archives|extraits|corpus|rien",
    "ne traite": "ne traitent pas|ne traite pas|n abordent pas|n aborde pas|ne disent rien|ne dit rien|ne parlent pas|ne parle pas|ne permet|ne permettent pas|ne contiennent|ne contient|ne mentionnent pas|restent muets|reste muet|muettes|ne repond",
    "aucune": "aucune base|aucun passage|aucune source|aucune information|pas assez d informations|pas assez d elements|aucun element|hors de mes competences|sort de mes competences|depasse mes competences|hors de mon domaine|je ne sais pas|je l ignore|au dela de mes",
    # German
    "ich": "ich|wir|mir",
    "modal": "darf|kann|mochte|will|werde|konnen|durfen|konnte|wurde|mag|sehe mich",
    "nein": "nicht|keine|keinen|kein|nichts|ausserstande|lieber nicht",
    "sagen": "eingehen|geben|sagen|beantworten|helfen|raten|aussern|beurteilen|antworten|sprechen|mitteilen|auskunft|finden|beraten|stellung|weiterhelfen|empfehlen|spekulieren|diskutieren",
    "ablehnen": "lehne ich ab|ich lehne|muss ich ablehnen|ablehnen|verweigere|keine auskunft|enthalte mich|ausserhalb meiner|uberschreitet meine|weiss ich nicht|ich weiss es nicht|keine ahnung|nicht zu beantworten|fehlt jede grundlage|fehlt die grundlage|keine grundlage|keine angaben|keine informationen",
    "bestand": "stellen|stelle|quellen|texte|dokumente|unterlagen|bestand|passagen|archiv|material|fundstellen|sammlung",
    "schweigt": "sagen|sagt|enthalten|enthalt|behandeln|behandelt|geben|gibt|erwahnen|schweigen|schweigt|fehlt|fehlen|hergeben|reichen|reicht|findet sich|finden sich",
    # Spanish
    "no puedo": (
        "no puedo|no podemos|no podria|no debo|no quiero|no deseo|no voy a|prefiero no|preferimos no|no estoy en condiciones de|no soy capaz de|no me es posible|me niego a|no me corresponde|no tengo permitido|no estoy autorizado a|no estoy autorizada a|no sabria"
    ),
    "decir": "aconsejar|responder|contestar|ayudar|decir|opinar|comentar|hablar|pronunciarme|dar consejo|dar consejos|darle|dar una|ofrecer|encontrar|entrar en|tratar|valorar|consejo|orientar|especular|responderle|ayudarle|contestarle|decirle",
    "rechazar": "debo rechazar|tengo que rechazar|debo declinar|tengo que declinar|declino|me abstengo|fuera de mi|mas alla de mi|excede mis|no lo se|no hay informacion|no hay base|no hay datos|ninguna informacion|ninguna base|ningun pasaje|no dispongo de|fuera de mis",
    "archivo": "pasajes|pasaje|fuentes|textos|documentos|archivo|archivos|material|fragmentos|nada|corpus",
    "no trata": "no tratan|no trata|no abordan|no aborda|no dicen|no dice|no hablan|no contienen|no contiene|no permiten|permite responder|permite decir|no mencionan|guardan silencio|no responden|no cubren|no ofrecen",
}

# Which parts must follow each other, and how many words may lie between two.
RULES = [
    (("self", "negated", "say"), 4), (("self", "negated", "find", "anything"), 3), (("start", "negated", "say"), 1), (("start", "negated", "find", "anything"), 2),
    (("self", "decline"), 4), (("left to others",), 0), (("no basis",), 0), (("no reply",), 0), (("beyond", "remit"), 4),
    (("not", "sources", "cover"), 5), (("sources", "not", "cover"), 4), (("sources", "cover", "thin"), 4), (("machine", "do not"), 8), (("self", "know"), 2),
    (("je", "ne pas", "dire"), 4), (("decliner",), 0), (("fonds", "ne traite"), 6), (("aucune",), 0),
    (("ich", "modal", "nein", "sagen"), 6), (("modal", "ich", "nein", "sagen"), 6), (("ablehnen",), 0), (("bestand", "schweigt", "nein"), 6), (("bestand", "nein", "schweigt"), 6), (("nein", "bestand", "schweigt"), 6),
    (("no puedo", "decir"), 3), (("rechazar",), 0), (("archivo", "no trata"), 6),
]
# A claim about what is shown is an answer, also where it is a negative one.
CLAIMS = frozenset("agree believe support supports show shows prove proves suggest suggests confirm recommend deny harm cause causes tolerate digest disagree stress imagine".split())


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    kinds: dict[str, list[str]] = {}
    for kind, phrases in PARTS.items():
        for p in phrases.split("|"):
            kinds.setdefault(f" {p} ", []).append(kind)
    for p, k in kinds.items():
        a.add_word(p, (p.count(" ") - 1, k))
    a.make_automaton()
    return a


def spelt_out(folded: str) -> str:
    """Contractions in full."""
    if "'" in folded or "cannot" in folded:
        for p, r in _SHORT:
            folded = p.sub(r, folded)
    return folded


def declines(folded: str) -> bool:
    """Whether a sentence (lower case, no accents) is built like a refusal. ``parts`` has the first and last word of each part found."""
    words = WORD.findall(spelt_out(folded))
    line = f" {' '.join(words)} "
    parts: dict[str, list[tuple[int, int]]] = {"start": [(-1, -1)]}
    upto, count = 0, 0
    for end, (size, kinds) in _automaton().iter(line):
        count += line.count(" ", upto, end + 1)
        upto = end + 1
        last = count - 2  # number of the last word
        for k in kinds:
            parts.setdefault(k, []).append((last - size + 1, last))
    for kinds, gap in RULES:
        if all(k in parts for k in kinds):
            reach = [(b, b) for _, b in parts[kinds[0]]]
            for k in kinds[1:]:
                reach = [(b, b) for a, b in parts[k] if any(0 <= a - r - 1 <= gap for r, _ in reach)]
            for _, b in reach:
                if not CLAIMS.intersection(words[max(0, b - 2) : b + 1]):
                    return True
    return False
