import random
import re

from lodestone.llm.decontam import contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def _got(spark, docs, items):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, fps string")
    i = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, ka int")
    rows = contamination(d, i).collect()
    return [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in rows], decontaminate(d, i)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["École", "ÉCOLE", "naïve", "42"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    bodies = {i: say(rng.choice([1, 3, 9, 10, 11, 30])) for i in range(12)}
    items = [(i, " ".join(b)) for i, b in bodies.items()] + [(3, " ".join(bodies[3])), (None, " ".join(bodies[5])),
                                                             (50, None), (51, " .,"), (52, "W1")]
    docs = [(None, None), (1, ""), (2, "?!"), (3, " ".join(say(9)))]
    for i in range(60):
        body = say(rng.randint(0, 200))
        for b in rng.sample(list(bodies.values()), rng.randint(0, 2)):
            cut = rng.randint(0, 3)
            at = rng.randint(0, len(body))
            body[at:at] = b[cut:]
        docs.append((10 + i, rng.choice([" ", ", ", "\n"]).join(body).upper() if i % 7 == 0 else " ".join(body)))
    docs += docs[-5:]
    got, kept = _got(spark, docs, items)
    want = brute(docs, items)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert kept.columns == ["doc_id", "text", "fps"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, _, n, _ in want if n == 0), key=str)


def test_empty_tables(spark):
    got, kept = _got(spark, [(1, "some words here"), (2, None)], [])
    assert sorted(got) == [(1, 3, 0, []), (2, 0, 0, [])] and kept.count() == 2
    got, kept = _got(spark, [], [(1, "some words")])
    assert got == [] and kept.count() == 0
