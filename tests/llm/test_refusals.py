"""Refusals and honest answers that stand in no given table."""

import re

from loomline.llm import languages, qa_defects
from loomline.llm.refusals import declines

REFUSED = [
    "I refuse to answer that.", "Sorry, that is beyond my knowledge.", "As an AI language model, I don't give opinions on this.", "I can't help you with this request.", "I'm afraid I am not able to comment on individual cases.",
    "I won't discuss dosage.", "I do not know the answer.", "The documents don't contain information about this question.", "None of the sources discuss that.", "Nothing in my notes says anything about it.",
    "I'm not comfortable giving guidance on medication, so I must respectfully decline.", "We could not find any passage that deals with it.", "There is no information on this in the library.", "This question goes beyond the scope of what I do.",
    "It is not possible to answer this from the text.", "I would prefer not to speculate.", "That question can't be answered here.", "My apologies, but I'm not qualified to advise on surgery.", "I have no knowledge of that.", "There isn't enough evidence in the archive to reply.",
    "Je ne suis pas en mesure de répondre à cette question.", "Désolé, je ne peux pas vous aider.", "Je refuse de commenter ce cas.", "Les documents n'abordent pas cette question.", "Aucune information disponible à ce sujet.", "Je ne sais pas.", "Nous ne souhaitons pas donner d'avis médical.",
    "Das kann ich leider nicht beantworten.", "Dazu möchte ich keine Stellung nehmen.", "Ich darf hierzu keine Auskunft geben.", "Die Quellen enthalten dazu nichts.", "Ich weiß es nicht.", "Tut mir leid, dabei kann ich nicht helfen.", "Das muss ich ablehnen.",
    "No puedo ayudarle con eso.", "Lo siento, no estoy en condiciones de opinar.", "Las fuentes no dicen nada al respecto.", "No hay información sobre este tema.", "Me niego a responder.", "Prefiero no comentar este caso.",
]
HONEST = [
    "Eat fruit so the liver has sugar to work with.", "I'm unable to agree with the common view: sugar is fine for most people.", "People who can't digest milk often do well with cheese.", "He refused to take salt and felt worse within days.", "The evidence does not support the claim that salt is harmful.",
    "Nothing works as fast as orange juice.", "I would not take more than two grams a day.", "No, it raises the pulse.", "You should not answer hunger with coffee alone.", "I couldn't tolerate starch for years, and fruit solved it.",
    "Sorry to hear that; the usual cause is too little light.", "I don't recommend fish oil, because it oxidises.", "The study found no difference between the two groups.", "Without enough sugar the liver can't store glycogen.", "I decided to stop coffee in the evening.",
    "Some doctors decline in skill when they see few patients.", "Sleep is beyond doubt the best remedy.", "Milk contains calcium, and the lack of it raises phosphate.", "It can't hurt to add some gelatin to the broth.", "Unfortunately most oils go rancid, so butter is the safer choice.",
    "Je ne mange pas de pain le soir, et je dors mieux.", "Le sel ne pose pas de problème chez la plupart des gens.", "Rien ne remplace la lumière du matin.", "Les huiles ne conviennent pas au foie.", "Il ne faut pas craindre le sucre des fruits.", "Je préfère le beurre à l'huile, car il est stable.",
    "Ich esse abends kein Brot und schlafe besser.", "Die Leber kann ohne Zucker kein Glykogen speichern.", "Nein, Salz schadet den meisten nicht.", "Man sollte nicht zu spät essen.", "Kaffee hilft vielen, aber nicht am Abend.", "Die Texte sagen, dass Licht am Morgen hilft.", "Nichts wirkt so schnell wie Obst.",
    "No tomo café por la noche porque no duermo.", "El hígado no puede guardar glucógeno sin azúcar.", "Nada ayuda tanto como la luz.", "No es malo para la mayoría.", "La sal no daña a casi nadie.", "Los aceites no convienen al hígado.", "Prefiero la mantequilla al aceite.",
]


def judged(answer):
    return qa_defects.is_refusal(answer, qa_defects._automaton(qa_defects.COURTESY), qa_defects._automaton(qa_defects.ASKED))


def test_refusals_by_their_parts():
    assert len(REFUSED) == len(HONEST) == 40
    missed, wrong = [a for a in REFUSED if not judged(a)], [a for a in HONEST if judged(a)]
    print(missed, wrong)
    assert len(missed) <= 4 and len(wrong) <= 4


def test_regret_before_an_answer_is_none():
    assert not judged("I can't give advice on doses, but most people do well with two grams of salt a day.")
    assert judged("I am sorry, but I can't give advice on doses.")
    assert not declines("") and not declines("...") and not declines("word " * 1000)


def test_last_citations_of_any_length():
    many = "[" + ", ".join(str(i) for i in range(1, 200)) + "]"
    assert qa_defects.without_last_citations(f"Salt helps. {many} (source 3) [1]") == "Salt helps."
    assert not qa_defects.is_truncated(f"Salt helps most of the people who try it. {many}")
    assert qa_defects.is_truncated("A word before.\n\nMore of it.\n\nAnd so on.\n\nHere are three points to note.\nFirst, the salt.")


def test_stopwords_are_function_words():
    """No word of a subject, a measure or a time of day is a stopword."""
    content = set("gram grams gramm gramme grammes day days jour tag dia día week weeks wochen semaines semanas cold froid frío friere normal take prendre nehmen tomar salt milk people lien importa verdad lese wichtiger connected expected".split())
    assert not content & {w for ws in languages.STOPWORDS.values() for w in ws}
    assert all(re.fullmatch(r"[^\W\d_]+", w) for ws in languages.STOPWORDS.values() for w in ws)
    assert languages.language("The milk is in the glass and it is cold") == "en"
    assert languages.language("La leche está en el vaso y no está fría") == "es"
    assert languages.language("Le lait est dans le verre et il est froid") == "fr"
    assert languages.language("Die Milch ist im Glas und sie ist kalt") == "de"
