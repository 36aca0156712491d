"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of the last ``window`` lines marks a line as a
possible chunk end; the first of a run of marked lines ends a chunk. The rule
looks at nearby lines only, so an inserted or deleted line moves no boundary
further away, and a passage gets the same chunks wherever it stands. No chunk
has a single line unless the document has.

Chunks of two lines or more are compared over the whole corpus: first by hash
(ids and hashes are shuffled, no text), then those whose hash repeats byte by
byte. The occurrence with the smallest (id, line) stays, all others go.

A repeated passage without a whole chunk between two common ends is missed by
that. With ``rules`` short chunks are compared as well, in which both ends are
chosen by what is between them: under each of several independent rules a bit of
the rolling hash of a line and the next opens a chunk, and another bit of that of
a line and the one before closes it, at most ``REACH`` lines on. A repeated passage
holds the same short chunks wherever it stands, so of two lines it is found if one
rule of them opens and closes there: 1 - (3/4)^rules.

With ``every_pair`` nothing is missed: all pairs of neighbouring lines are
compared as well, and a line goes if a chunk or pair with it occurs earlier.
Short chunks and pairs inside a chunk that occurs earlier are left out beforehand
(its first occurrence has them all), so long repeats cost what their chunks cost.
Their spans overlap: the first occurrence of a line always stays, but two lines may
stay in different documents.

Scale: counts per hash and per text are partial aggregates; the join of a
very common chunk's occurrences with its one keeper row is split by AQE; only
repeated chunks' texts are shuffled by text, and documents twice by id.

Defined cases: a null text counts as empty; an empty text or a single line is
left alone; the same row twice is one document, so neither copy loses lines to
the other; a null id sorts first; of rows that share an id but not the text,
each is treated by its own text. An emptied document keeps its row, with an
empty text. Other columns of ``dedup_lines`` pass through unchanged. Write the
result before a Python function reads its text: Spark 4.1 can't evaluate a
Python function over an expression with lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import bound, text_or_empty, written

#: Lines in the rolling hash; one line in DIVISOR is a possible chunk end.
WINDOW = 2
DIVISOR = 2
#: Independent rules of short chunks (16 at most: bits of the rolling hash), and the lines of one at most.
RULES = 10
REACH = 3
#: Factor of the rolling polynomial and the prime that bounds it.
BASE = 1_000_003
PRIME = 2_147_483_647


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5 as a long."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks(text: Column, window: int = WINDOW, divisor: int = DIVISOR, of_lines: bool = False) -> Column:
    """Array of (first line, last line, hash) of a text's chunks of two lines or more; lines count from 1.

    The hash is of the line hashes, or with ``of_lines`` of the lines themselves.
    """
    factors = [pow(BASE, j, PRIME) for j in range(window)]

    def rolled(h: Column, lines: Column) -> Column:
        n = F.size(h)

        def marked(_, i):
            # get(): null before the first line, which counts as 0
            parts = [F.coalesce((F.get(h, i - j) % PRIME) * F.lit(f) % PRIME, F.lit(0)) for j, f in enumerate(factors)]
            total = parts[0]
            for x in parts[1:]:
                total = total + x
            return (total % PRIME) % divisor == 0

        def ends(m: Column) -> Column:
            return F.concat(F.filter(F.sequence(F.lit(1), n), lambda i: (i >= 2) & (i <= n - 2) & F.get(m, i - 1) & ~F.get(m, i - 2)), F.array(n))

        def spans(e: Column) -> Column:
            return F.transform(e, lambda last, k: F.struct(
                F.coalesce(F.get(e, k - 1) + 1, F.lit(1)).alias("first"), last.alias("last")))

        def hashed(s: Column) -> Column:
            return F.transform(F.filter(s, lambda x: x["last"] > x["first"]), lambda x: F.struct(
                x["first"].alias("first"), x["last"].alias("last"),
                F.xxhash64(F.slice(lines if of_lines else h, x["first"], x["last"] - x["first"] + 1)).alias("hash")))

        return bound(F.transform(h, marked), lambda m: bound(ends(m), lambda e: bound(spans(e), hashed)))

    return bound(lines_of(text), lambda lines: bound(F.transform(lines, line_hash), lambda h: rolled(h, lines)))


def pairs(text: Column) -> Column:
    """Array of (first line, last line, hash) of every two neighbouring lines of a text; lines count from 1."""
    def hashed(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: i < F.size(lines))
        return F.transform(starts, lambda i: F.struct(
            i.alias("first"), (i + 1).alias("last"), F.xxhash64(F.get(lines, i - 1), F.get(lines, i)).alias("hash")))

    return bound(lines_of(text), hashed)


def short_chunks(text: Column, rules: int = RULES, reach: int = REACH) -> Column:
    """Array of (first line, last line, hash) of a text's short chunks under all rules; lines count from 1."""
    def rolled(h: Column) -> Column:
        # the window of a line and the one before; null for the first line
        return F.transform(h, lambda x, i: (x % PRIME + F.get(h, i - 1) % PRIME * BASE % PRIME) % PRIME)

    def spans(lines: Column, r: Column) -> Column:
        n = F.size(lines)

        def ends(first: Column) -> Column:
            # first counts from 1, so the window that begins with it is r[first]; past the last line there is none
            opened, closed, out = F.get(r, first), None, []
            for more in range(1, reach):
                closing = F.shiftright(F.get(r, first + (more - 1)), 15)
                fresh = opened.bitwiseAND(closing) if closed is None else opened.bitwiseAND(closing).bitwiseAND(F.bitwise_not(closed))
                out.append(F.when(fresh.bitwiseAND(F.lit((1 << rules) - 1)) != 0, F.struct(
                    first.alias("first"), (first + more).alias("last"), F.xxhash64(F.slice(lines, first, F.lit(more + 1))).alias("hash"))))
                closed = closing if closed is None else closed.bitwiseOR(closing)
            return F.filter(F.array(*out), lambda x: x.isNotNull())

        starts = F.filter(F.sequence(F.lit(1), n), lambda i: i < n)
        return F.flatten(F.transform(starts, ends))

    return bound(lines_of(text), lambda lines: bound(rolled(F.transform(lines, line_hash)), lambda r: spans(lines, r)))


def _recurring(found: DataFrame, label: str) -> DataFrame:
    """The rows whose hash occurs more than once."""
    # written, so that both sides of the join are plain exchanges and AQE can split a common hash
    twice = written(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), label)
    return found.join(twice, "hash", "left_semi").select("id", "key", "first", "last", "hash")


def _recurring_parts(base: DataFrame, spans: DataFrame, parts: Column) -> DataFrame:
    """Parts whose hash occurs more than once, not counting those inside a chunk of ``spans`` that occurs earlier."""
    firsts = written(spans.groupBy("hash").agg(F.min(F.struct("id", "first")).alias("keeper")), "line-firsts")
    later = (spans.join(firsts, "hash").where(~F.struct("id", "first").eqNullSafe(F.col("keeper")))
             .select(F.col("id").alias("id2"), F.col("key").alias("key2"), F.col("last").alias("last2"), F.explode(F.expr("sequence(first, last - 1)")).alias("first2")))
    every = written(base.select("id", "key", F.inline(parts)), "line-every-part")  # read twice, hashed once
    found = written(_recurring(every, "line-part-hashes"), "line-parts")
    apart = found.join(later, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")) & (F.col("first") == F.col("first2"))
                       & (F.col("last") <= F.col("last2")), "left_anti")
    return _recurring(written(apart, "line-parts-apart"), "line-parts-apart-hashes")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW, divisor: int = DIVISOR, every_pair: bool = False, rules: int = 0) -> DataFrame:
    """Chunks (and short chunks or pairs) to remove: ``(id, key, first, last)``; ``key`` tells texts of one id apart."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    spans = _recurring(base.select("id", "key", F.inline(chunks(F.col("text"), window, divisor, every_pair or rules > 0))), "line-hashes")
    if every_pair or rules:
        spans = written(spans, "line-spans")
        parts = pairs(F.col("text")) if every_pair else short_chunks(F.col("text"), rules)
        spans = spans.unionByName(_recurring_parts(base, spans, parts))
    named = (spans.groupBy("id", "key")
             .agg(F.collect_set(F.struct("first", "last")).alias("spans"))
             .select(F.col("id").alias("id2"), F.col("key").alias("key2"), "spans"))
    texts = (base.join(named, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")))
             .select("id", "key", F.inline(bound(lines_of(F.col("text")), lambda lines: F.transform("spans", lambda s: F.struct(
                 s["first"].alias("first"), s["last"].alias("last"),
                 F.array_join(F.slice(lines, s["first"], s["last"] - s["first"] + 1), "\n").alias("chunk")))))))
    texts = written(texts, "line-chunks")
    keepers = written(texts.groupBy("chunk").agg(F.min(F.struct("id", "first")).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "line-keepers")
    return (texts.join(keepers, "chunk")
            .where(~F.struct("id", "first").eqNullSafe(F.col("keeper")))
            .select("id", "key", "first", "last"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                window: int = WINDOW, divisor: int = DIVISOR, every_pair: bool = False, rules: int = 0) -> DataFrame:
    """``docs`` with repeated chunks cut from the text, and ``lines_before``, ``lines_removed``, ``chunks_removed``.

    With ``rules`` repeated short chunks go too; with ``every_pair`` every repeated passage of two lines or more.
    ``chunks_removed`` counts them too, but for those within a removed chunk.
    """
    gone = (repeated_chunks(docs, id_col, text_col, window, divisor, every_pair, rules).groupBy("id", "key")
            .agg(F.collect_set(F.struct("first", "last")).alias("__gone"))
            .select(F.col("id").alias("__id"), F.col("key").alias("__key"), "__gone"))
    # a row takes its text through the shuffle once, and is read as empty only after it
    joined = (docs.withColumn("__text_key", F.xxhash64(text_or_empty(text_col)))
              .join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left")
              .withColumn("__text", text_or_empty(text_col)))
    out = F.array_distinct(F.flatten(F.transform("__gone", lambda s: F.sequence(s["first"], s["last"]))))
    kept = bound(lines_of(F.col("__text")), lambda lines: F.transform(
        F.array_except(F.sequence(F.lit(1), F.size(lines)), out), lambda i: F.get(lines, i - 1)))
    untouched = F.col("__gone").isNull()
    counts = {"lines_before": F.size(lines_of(F.col("__text"))).cast("long"),
              "lines_removed": F.when(untouched, F.lit(0)).otherwise(F.size(out)).cast("long"),
              "chunks_removed": F.when(untouched, F.lit(0)).otherwise(F.size("__gone")).cast("long")}
    text = F.when(untouched, F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in counts],
                         *[v.alias(k) for k, v in counts.items()])
