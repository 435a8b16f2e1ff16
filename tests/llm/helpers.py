import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int, n int, ids binary, kept string, size long"


def words(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=120, vocabulary=400):
    """Texts with exact and near copies, shared passages, runs, odd spaces, nulls and very short and long texts."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    say = lambda k: [rng.choice(pool) for _ in range(k)]
    passage, texts = say(60), [None, "", " \n\t ", "One", "one two three four", "a " * 90, "x y " * 60]
    while len(texts) < n:
        kind = rng.random()
        w = say(rng.choice([3, 6, 8, 12, 20, 40, 90, 300]))
        if kind < 0.3 and len(texts) > 20:
            w = words(rng.choice(texts[7:])) or w
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(max(1, len(w)))
                w = w[:at] + say(rng.choice([0, 1, 1])) + w[at + 1 :] if rng.random() < 0.7 else w[:at] + [rng.choice(pool)] + w[at:]
        elif kind < 0.45:
            at = rng.randrange(len(w))
            w = w[:at] + passage[rng.randrange(20) : rng.randrange(41, 61)] + w[at:]
        elif kind < 0.5:
            w = w + [rng.choice(pool)] * rng.randrange(1, 60)
        elif kind < 0.55:
            w = w * 2
        sep = rng.choice([" ", " ", "\n", "  ", "\t"])
        texts.append(sep.join(x.upper() if rng.random() < 0.02 else x for x in w))
    return texts


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, ["en", None][i % 7 == 0], [None, "s1", "s2", "z"][i % 4], len(t or ""), 1, 2, b"", "k", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(4)
