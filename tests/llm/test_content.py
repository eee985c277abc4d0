"""Content scores on sentences that stand in no given table, and without any cue."""

import random

import numpy as np

from loomline.llm import toxicity

OUTSIDE = {
    "abusive": [
        "Go hang yourself, you hideous freak.", "You are nothing but trash, get lost.", "Someone should punch you in the throat.", "I will come for you, I know where you live.", "Nobody asked you, you pathetic clown.", "Kill yourself, loser.",
        "Tu es vraiment un abruti, dégage.", "Du bist so ein Vollidiot, halt die Fresse.", "Eres un payaso, vete a la mierda.", "I swear I will smash your jaw.",
    ],
    "hateful": [
        "All Martians should be exterminated, they are savages.", "Those people breed like rats and belong in cages.", "Foreigners are vermin and must be driven out.", "These refugees are a plague, deport them all.", "Gypsies are born thieves, you cannot trust them.",
        "Les étrangers sont des nuisibles, il faut les expulser.", "Diese Leute sind Abschaum und gehören weggesperrt wie Ratten, man muss sie vertreiben.", "Los inmigrantes son escoria y hay que expulsarlos.", "Muslims are subhuman and must be wiped out.", "They are parasites, their kind should be gassed.",
    ],
    "sexual": [
        "He slid inside her and she climaxed loudly, naked on the floor.", "Hot nude escort girls, strip on cam now.", "She licked his cock until he came.", "Free porn videos, no signup.", "Horny wives want to fuck tonight.",
        "Elle gémissant, nue, prit sa queue.", "Geile nackte Mädchen vor der Kamera, ohne Anmeldung.", "Tías desnudas y cachondas en directo, sin registro.", "Her pussy was wet and dripping.", "Watch gangbang porn in our sex chat.",
    ],
}
HARMLESS = [
    "The patients in this study reported a lower libido and vaginal dryness.", "Naked mole rats live long lives.", "I was stupid to skip breakfast.", "It is hurtful to call old people useless.", "Burn fat by eating less starch, and brush your teeth.",
    "You should be careful with iodine.", "Bacteria should be eliminated from the gut before the test.", "The women in the trial took salt.", "Wet hair cools the neck quickly.", "Dogs and rats are animals that tolerate cold.", "He cut up the carrots and crushed the garlic.",
    "Your liver can't store sugar without thyroid.", "She screamed when she saw the bill.", "They are tired, and all of them sleep badly.", "Cheese and eggs are not dirty foods.", "Nobody should say that immigrants are vermin; it is offensive.", "My dog is an idiot, but I love him.",
    "Doctors should refuse to prescribe this drug.", "The disease spreads through the lungs.", "A miserable winter makes you sleepy.",
]


def flags(text, weights=None):
    finder = toxicity.automaton()
    found = toxicity.sentences(text, finder)
    p = toxicity.sentence_scores(found, toxicity.prior() if weights is None else weights)
    return {c for c, q in zip(toxicity.CATEGORIES, 1 - np.prod(1 - p, axis=0), strict=True) if q >= 0.5}


def test_sentences_from_outside():
    missed = [t for c, ts in OUTSIDE.items() for t in ts if c not in flags(t)]
    wrong = [t for t in HARMLESS if flags(t)]
    print(missed, wrong)
    assert len(missed) <= 3 and len(wrong) <= 1


def test_places_are_those_of_the_text():
    text = "Café &amp; milk.\n\nYou are a W0RTHL3SS p.i.g!  Salt is\x01 fine. S. h. e. i. s. well."
    found = toxicity.sentences(text, toxicity.automaton())
    assert [text[a:b].split()[0] for a, b, *_ in found] == ["Café", "You", "Salt", "S."]
    worst = toxicity.sentence_scores(found, toxicity.prior())[:, 0].argmax()
    assert text[found[worst][0] : found[worst][1]].strip() == "You are a W0RTHL3SS p.i.g!"


def test_learnt_weights_carry_over_to_documents_without_cues():
    """Labels alone, no cue in any text: held-out documents with the marked kinds of sentence are found, the others aren't."""
    rnd = random.Random(8)
    common = [f"{a}{b}" for a in ("bal", "dor", "fim", "gun", "hep") for b in ("ka", "lo", "mi", "nu", "po", "ra")]
    marks = [f"zz{k}q" for k in range(6)]
    finder = toxicity.automaton()

    def doc(bad):
        out = [" ".join(rnd.choice(common) for _ in range(8)) + "." for _ in range(12)]
        if bad:
            words = [rnd.choice(common) for _ in range(4)] + rnd.sample(marks, 2)
            out.insert(rnd.randrange(12), " ".join(words) + ".")
        return " ".join(out)

    def bag(text):
        return [toxicity.features(s, cues) for _, _, s, cues in toxicity.sentences(text, finder)]

    made = [(doc(k % 4 == 0), float(k % 4 == 0)) for k in range(1200)]
    w = toxicity.train([(bag(t), y) for t, y in made[:800]])
    held = [(bool(flags(t, w)), y) for t, y in made[800:]]
    recall = sum(f for f, y in held if y) / sum(y for _, y in held)
    wrong = sum(f for f, y in held if not y) / sum(1 - y for _, y in held)
    print(recall, wrong)
    assert recall >= 0.9 and wrong <= 0.02


def test_training_takes_less_than_plain_sums():
    """A round of the training takes less CPU than sums by feature and by sentence that gather and multiply anew for each category."""
    import time

    rnd = np.random.default_rng(5)
    first = len(toxicity.FEATURES)
    bags = [([([0, 1], np.unique(rnd.integers(0, 15_000, 60)).tolist()) for _ in range(25)], float(k % 4 == 0)) for k in range(500)]
    row, at, value = [], [], []
    for i, (named, hashed) in enumerate(x for own, _ in bags for x in own):
        row += [np.full(len(named) + len(hashed), i, dtype=np.int32)]
        at += [np.r_[named, np.array(hashed) + first]]
        value += [np.r_[np.ones(len(named)), np.full(len(hashed), len(hashed) ** -0.5)]]
    row, value = np.concatenate(row), np.concatenate(value)
    used, at = np.unique(np.concatenate(at), return_inverse=True)
    w, step = rnd.random((3, len(used))), rnd.random((12_500, 3))

    def plain(rounds):
        for _ in range(rounds):
            np.stack([np.bincount(row, w[c, at] * value, 12_500) for c in range(3)], axis=1)
            np.stack([np.bincount(at, step[row, c] * value, len(used)) for c in range(3)])

    def took(f, *args, **more):
        began = time.process_time()
        f(*args, **more)
        return time.process_time() - began

    fixed = min(took(toxicity.train, bags, rounds=0) for _ in range(2))
    own, other = took(toxicity.train, bags, rounds=60) - fixed, took(plain, 60)
    print(own, other)
    assert own < 0.85 * other
