"""Line dedup against a plain implementation, and the SQL oracle on a fixture."""

import hashlib

import numpy as np

from vitrine.llm.line_chunks import BASE, DIVISOR, PRIME, REACH, RULES, dedup_lines


def plain_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    mark = [(h[i] % PRIME + (h[i - 1] % PRIME * BASE % PRIME if i else 0)) % PRIME % DIVISOR == 0 for i in range(len(h))]
    n, out, first = len(lines), [], 0
    for i in range(n):  # i counts from 0
        if i == n - 1 or 1 <= i <= n - 3 and mark[i] and not mark[i - 1]:
            out.append((first, i))
            first = i + 1
    return lines, [(a, b) for a, b in out if b > a]


def plain_dedup(rows):
    """rows: distinct ids -> text."""
    seen, out = set(), {}
    for i in sorted(rows):
        lines, spans = plain_chunks(rows[i])
        gone = set()
        for a, b in spans:
            c = "\n".join(lines[a:b + 1])
            if c in seen:
                gone |= set(range(a, b + 1))
            seen.add(c)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def corpus():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    line = lambda: " ".join(rng.choice(words, rng.integers(1, 9)))
    shared = [line() for _ in range(14)]
    rows = {}
    for i in range(60):
        own = [line() for _ in range(rng.integers(1, 25))]
        if i % 3 == 0:
            at = rng.integers(0, len(own) + 1)
            own[at:at] = shared
        rows[i] = "\n".join(own)
    rows |= {60: rows[5], 61: "", 62: "\n", 63: "\n\n\n\n", 64: "a\n" * 300, 65: "a\n" * 301, 66: "only one line", 67: "only one line",
             68: "two\nlines", 69: "two\nlines", 70: "é\nü\r\nß", 71: "é\nü\r\nß", 72: "z" * 200_000}
    return rows


def test_as_the_plain_method(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows.items()], "doc_id long, text string, hash string, first long").repartition(5)
    out = dedup_lines(docs)
    assert out.columns == [*docs.columns, "lines_before", "lines_removed", "chunks_removed"]
    got = {r["doc_id"]: (r["text"], r["lines_before"], r["lines_removed"]) for r in out.collect()}
    want = plain_dedup(rows)
    assert got == want
    assert got[60][0] == "" and got[69][0] == "" and got[67][0] == "only one line"
    # a shared passage goes from later documents but for its ends
    assert got[57][2] >= 6


def test_edge_rows(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, None), (None, "a\nb\nc"), (3, "a\nb\nc"), (4, ""), (5, "q\nr"), (5, "s\nt")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    by = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in out if r["text"] is not None)
    assert by == [(-1, "a\nb\nc"), (1, ""), (1, ""), (3, ""), (4, ""), (5, "q\nr"), (5, "s\nt")]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def plain_pairs(rows):
    """Every line in two neighbouring lines that occur earlier goes; rows: distinct ids -> text."""
    seen, out = set(), {}
    for i in sorted(rows):
        lines, gone = rows[i].split("\n"), set()
        for k in range(len(lines) - 1):
            pair = (lines[k], lines[k + 1])
            if pair in seen:
                gone |= {k, k + 1}
            seen.add(pair)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_every_planted_passage_goes(spark):
    rows = corpus()
    line = iter(f"line {k}" for k in range(10**6))
    planted = {}
    for n in range(2, 13):
        for _ in range(20):
            passage = [next(line) for _ in range(n)]
            for copy in range(2):
                own = [next(line) for _ in range(6)]
                own[3:3] = passage
                rows[1000 + 2 * len(planted) + copy] = "\n".join(own)
            planted[1001 + 2 * len(planted)] = n
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    out = dedup_lines(docs, every_pair=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    got = {r["doc_id"]: (r["text"], r["lines_before"], r["lines_removed"]) for r in out.collect()}
    assert got == plain_pairs(rows)
    assert all(got[i][2] == n and got[i - 1][2] == 0 for i, n in planted.items())
    by_chunks = plain_dedup(rows)
    assert sum(by_chunks[i][2] for i in planted) < sum(planted.values()) / 2


def test_edge_rows_with_every_pair(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, None), (None, "a\nb\nc"), (3, "x\na\nb\nz"), (4, ""), (5, "q\nr"), (5, "s\nt")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), every_pair=True).collect()
    by = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in out if r["text"] is not None)
    assert len(out) == len(rows) and by == [(-1, "a\nb\nc"), (1, ""), (1, ""), (3, "x\nz"), (4, ""), (5, "q\nr"), (5, "s\nt")]


def plain_short(lines, rules, reach):
    """Spans (from 0) of the short chunks under all rules."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % PRIME for x in lines]
    r = [(h[i] + (h[i - 1] * BASE % PRIME if i else 0)) % PRIME for i in range(len(h))]
    out = set()
    for k in range(rules):
        for i in range(len(lines) - 1):
            if r[i + 1] >> k & 1:
                out |= {(i, j) for j in [next((j for j in range(i + 1, min(len(lines), i + reach)) if r[j] >> (k + 15) & 1), None)] if j is not None}
    return out


def plain_rules(rows, rules, reach):
    seen, out = set(), {}
    for i in sorted(rows):
        lines, spans = plain_chunks(rows[i])
        gone = set()
        for a, b in sorted({*spans, *plain_short(lines, rules, reach)}):
            c = "\n".join(lines[a:b + 1])
            if c in seen:
                gone |= set(range(a, b + 1))
            seen.add(c)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_short_chunks_find_planted_passages(spark):
    """Equal to the plain version, and nine of ten planted lines go for every length from two lines on."""
    rows = corpus()
    line = iter(f"line {k}" for k in range(10**6))
    planted = {}
    for n in range(2, 13):
        for _ in range(60):
            passage = [next(line) for _ in range(n)]
            for copy in range(2):
                own = [next(line) for _ in range(6)]
                own[3:3] = passage
                rows[1000 + 2 * len(planted) + copy] = "\n".join(own)
            planted[1001 + 2 * len(planted)] = n
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    out = dedup_lines(docs, rules=RULES)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    got = {r["doc_id"]: (r["text"], r["lines_before"], r["lines_removed"]) for r in out.collect()}
    assert got == plain_rules(rows, RULES, REACH)
    exact = plain_pairs(rows)
    for n in range(2, 13):
        of = [i for i, k in planted.items() if k == n]
        assert all(exact[i][2] == n for i in of)
        assert sum(got[i][2] for i in of) >= 0.9 * sum(exact[i][2] for i in of)
    assert all(got[i - 1][2] == 0 for i in planted)


def test_edge_rows_with_rules(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, None), (None, "a\nb\nc"), (4, ""), (5, "q\nr"), (5, "s\nt"), (6, "one line")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), rules=RULES).collect()
    by = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in out if r["text"] is not None)
    assert len(out) == len(rows) and by == [(-1, "a\nb\nc"), (1, ""), (1, ""), (4, ""), (5, "q\nr"), (5, "s\nt"), (6, "one line")]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string"), rules=RULES).count() == 0
