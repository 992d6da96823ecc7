import re
from collections import Counter

from lodestone.llm.queries import QUERIES
from lodestone.llm.rules import quality_rules

BLANK = re.compile(r"[ \t-\r]+")


def words(text):
    return [w for w in BLANK.split(text) if w]


def base(text):
    text = text or ""
    w = words(text)
    fives = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if fives[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def _row(r):
    return tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


GOOD = "This is a perfectly ordinary line of prose that says something.\nAnd here is the next one, which says a little more."
CASES = {
    "good": GOOD,
    "menu": GOOD.split("\n")[0] + "\n" + "\n".join("Home | About | Contact | Terms and more | Login" for _ in range(4)),
    "shout": "\n".join(f"BUY{i}!! NOW{i}!! CHEAP{i}!! GOODS{i}!!" for i in range(9)),
    "notice": GOOD + "\nAll Rights Reserved by the owner of this page",
    "noise": "a### b$$$ c%%% d&&& e*** f### g$$$ h%%% i&&& j*** k###",
    "repeats": "one two three four five six " * 5 + "seven eight nine",
    "overlap": "a a a a a a a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ee",
    "short": "too few words", "blank": " \n\t \n", "empty": "", "null": None,
    "unicode": "Ünïcödé wörds ärè còuntéd by còde point 😀 hère, übërall!\nund nòch eine Zeile, die gut ist.",
    "lines": "same line of a few words here.\nsame line of a few words here.\n\n\nother line of few words.",
    "long": " ".join(f"w{i}" for i in range(30000)) + ".",
}


def test_cases(spark):
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in CASES.items()] + [("good", GOOD, "clash", 2)],
                                 "doc_id string, text string, kept string, _words int")
    rows = quality_rules(docs).collect()
    assert len(rows) == len(CASES) + 1
    for r in rows:
        assert _row(r) == base(r["text"]), r["doc_id"]
    got = {r["doc_id"]: r for r in rows}
    assert {k for k, r in got.items() if r["kept"]} == {"good", "notice", "overlap", "unicode", "long"}
    assert got["notice"]["clean_text"] == GOOD and got["notice"]["n_lines_removed"] == 1
    assert got["menu"]["n_lines_removed"] == 4 and got["null"]["clean_text"] == ""
    assert quality_rules(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op10_quality_rules"](spark, sf_dir).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert _row(got[d["doc_id"]]) == base(d["text"])
        if labels.get(d["doc_id"]) == 1 and not got[d["doc_id"]]["base_failed"]:
            assert got[d["doc_id"]]["kept"]
