"""Language of a text by votes of stopwords, for en, fr, de and es."""

from __future__ import annotations

import re

# Stopwords that speak for one language. Words common to two lists vote for both.
STOPWORDS = {
    "en": (
        "the of and in is it that to a an are was were am but which when what with for from on at by as this these those than then "
        "not no yes or if who whom whose how why does do did can has have had having been be being they them their theirs there here you your yours i my mine me we our ours us she he him his her hers "
        "its about into over under between after before during through while once only most often may might should would could must shall "
        "will more less every each any some such whereas because without until unless since near too very also just still though although whether upon within against among both few many much own same so other another"
    ).split(),
    "fr": (
        "le la les un une des du de et en est que qui quoi dont dans pour par sur avec sans mais ou où ne pas plus ce cet cette ces ceci cela ça se sa son ses "
        "au aux il elle on ils elles je tu te toi nous vous votre vos notre nos leur leurs lui mon ma mes ton ta tes d l c s n qu j m t y quand parce comme tout toute toutes tous très bien "
        "entre pendant avant après sous chez vers contre selon malgré depuis même seulement alors être été suis es sommes êtes sont était étaient soit serait ont ai as a avons avez avait avaient aura oui non si souvent puis donc car ni "
        "lors lorsque aussi fait faire peut peux peuvent faut doit pourquoi comment combien quel quelle quels quelles lequel laquelle chaque plusieurs autre autres moins encore déjà toujours jamais ainsi afin"
    ).split(),
    "de": (
        "der die das den dem des ein eine einer eines einem einen und ist im in zu auf mit von für aber nicht nur auch es sich wie wenn "
        "dass ob bei beim nach vor über unter zwischen während sehr wird werden wurde wurden sind bin bist seid war waren wäre hat haben habe hast hatte hatten ich wir sie er du ihr ihre ihren ihrem ihnen ihm ihn mein meine meinen dein deine sein seine seinen unser unsere um am mich dich mir dir uns euch "
        "als oder denn doch so zum zur aus bis durch ohne gegen noch schon da dort hier ja nein kein keine keinen etwa man oft selten den "
        "jede jeder jedem jeden jedes manche alle alles etwas nichts niemand warum weshalb wieso wer was wann wo seit darf kann können konnte muss müssen soll sollte will wollen mag möchte weil damit bevor nachdem obwohl trotz wegen statt je also dann welche welcher welches dieser diese dieses diesen diesem ans ins vom"
    ).split(),
    "es": (
        "el la los las lo un una uno unos unas de del y e en es que por para con sin pero o u no sí si se su sus al le les me te mi mis tu tus nos yo tú él ella usted ustedes "
        "ellos ellas este esta estos estas ese esa esos esas esto eso aquel aquella aquellos como cuando porque pues más muy ya también tampoco entre durante antes después bajo sobre hasta "
        "desde según hacia contra mediante hay ha han he has hemos había son soy eres somos fue era eran ser sea está están estoy estar estaba tiene tienen puede pueden puedo debe deben debo cada otro otra otros otras mientras solo sólo cuál cuáles qué quién quiénes dónde cómo cuánto cuántos "
        "tras tan tanto todo toda todos todas algún alguna algunos algunas ningún ninguna nada nadie algo siempre nunca ni aunque sino luego así aquí allí ahora nuestro nuestra"
    ).split(),
}
WORD = re.compile(r"[^\W\d_]+")
_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words):
        _VOTES[_w] = (*_VOTES.get(_w, ()), _lang)


def votes(text: str | None) -> dict[str, float]:
    """Votes per language. A word of k languages gives each of them 1/k."""
    out = dict.fromkeys(STOPWORDS, 0.0)
    for w in WORD.findall((text or "").lower()):
        langs = _VOTES.get(w)
        if langs:
            for lang in langs:
                out[lang] += 1.0 / len(langs)
    return out


def language(text: str | None, default: str | None = None) -> str | None:
    """The language with most votes; default where there are none. Ties go to the first name in order."""
    v = votes(text)
    best = max(v.values())
    return min(k for k, x in v.items() if x == best) if best > 0 else default


# Spellings of language codes and names, to one code.
CODES = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "ingles"),
    "fr": ("fr", "fra", "fre", "french", "französisch", "français", "francés", "frances"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman"),
    "es": ("es", "spa", "spanish", "spanisch", "espagnol", "español", "espanol"),
}
NAME_TO_CODE = {name: code for code, names in CODES.items() for name in names}
