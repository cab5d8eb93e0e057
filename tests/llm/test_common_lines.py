import random
from collections import defaultdict

from millrace.llm.common_lines import repeated_lines, without_lines

LONG = "this line stands in many documents of a source"


def brute(rows, source, least_documents=8, share=0.1):
    seen, docs = defaultdict(set), defaultdict(set)
    key = lambda line: "".join(c for c in line if c.isalpha()).lower()
    of = lambda b: source.get(b, f"own {b}")
    for d, b, t in rows:
        docs[of(b)].add(d)
        for line in (t or "").split("\n"):
            if len(key(line)) >= 25:
                seen[of(b), key(line)].add(d)
    return {
        (d, n) for d, b, t in rows for n, line in enumerate((t or "").split("\n"), 1)
        if len(key(line)) >= 25 and len(seen[of(b), key(line)]) >= max(least_documents, share * len(docs[of(b)]))
    }


def test_matches_brute_force(spark):
    rng = random.Random(2)
    lines = [LONG, LONG.upper() + "!", "> " + LONG, "a line that only few of the documents ever hold", "short line", "", "ein anderer Satz, der oft genug vorkommt, um zu zählen"]
    rows = [(i, rng.choice([1, 2, 3, None]), "\n".join(rng.choices(lines, weights=[3, 1, 1, 1, 9, 3, 4], k=rng.randint(0, 6)))) for i in range(160)]
    rows += [(200, 1, None), (201, 4, "x" * 300_000 + "\n" + LONG), rows[5], rows[5]]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id long, board long, text string, slug string")
    boards = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t"), (9, "u")], "board long, slug string")
    got = {tuple(r) for r in repeated_lines(df, "id", "board", "text", boards, "slug").collect()}
    assert got == brute(rows, {1: "s", 2: "s", 3: "t"}) and got
    left = {r.id: r.text for r in without_lines(df, "id", "text", repeated_lines(df, "id", "board", "text", boards, "slug")).collect()}
    for d, _, t in rows:
        kept = None if t is None else "\n".join(line for n, line in enumerate(t.split("\n"), 1) if (d, n) not in got)
        assert left[d] == kept
    assert len(left) == len({r[0] for r in rows})


def test_nothing(spark):
    df = spark.createDataFrame([], "id long, board long, text string")
    boards = spark.createDataFrame([], "board long, slug string")
    assert repeated_lines(df, "id", "board", "text", boards, "slug").count() == 0
    one = spark.createDataFrame([(1, 1, LONG)], "id long, board long, text string")
    assert repeated_lines(one, "id", "board", "text", boards, "slug").count() == 0
    assert without_lines(one, "id", "text", repeated_lines(one, "id", "board", "text", boards, "slug")).first().text == LONG
