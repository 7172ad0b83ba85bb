"""Line dedup by a fixed-depth log-template tree, in DataFrame operations only.

A line's way through the tree: the number of its tokens, then its `depth` leading tokens.
Tokens that hold a digit are variable and count as `<*>`. In its leaf a line belongs to the
template of every line that has four of five tokens or more, at the same places, in common
with it; where they differ the template is variable, whatever stands there, at any length.
A line whose template stands in a document of smaller id is boilerplate and goes: each
template stays in the first document that has it.

Lines that are equal but for digits form a class, which aggregates of ids alone describe.
Only classes whose leaf holds another class of another document are compared, by their
tokens' hashes (32 bits). Two similar ones of n tokens differ in at most n div 5, so they
agree in one of n div 5 + 1 bands of tokens. A class first meets the earliest class of each
of its bands; what this doesn't settle meets the band's other members; where it is many that
ask in a large band, only those that agree in one more band of the remaining tokens, which
similar ones do. No line is left out, of any length.

Shuffles carry hashes and ids, texts only where lines are taken out of them; lines that a
third of all rows hold are reduced by partial aggregates before they travel.

Cases: a null text stays null, an empty one empty; blank lines stay; a line that recurs
within one document alone stays; a document may lose every line and is then empty; rows
with equal ids are one document; a null id counts as an id of its text's own; an empty
table gives no rows; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, written

#: Leading tokens that make up the tree's levels below the token count.
DEPTH = 2
#: One of so many tokens may differ between lines of a template.
APART = 5
#: Members up to which a band is compared as it is.
SMALL_BAND = 16
#: Bits of the table that tells which leaves hold several classes.
SLOTS = 1 << 22


def document_names() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("d"), F.xxhash64("text").alias("h")]


def tokens_of(raw: Column) -> Column:
    """A trimmed line's tokens, `<*>` for those that hold a digit."""
    masked = F.when(raw.rlike("[0-9]"), F.regexp_replace(raw, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(raw)
    return F.split(masked, " ")


def tree(docs: DataFrame, depth: int, kept: bool = False) -> DataFrame:
    """(d, h, line, w, n, leaf) of each line that isn't blank: d and h name the document, w holds its n tokens.

    kept: w is made before lines become rows, so that no filter or join on what follows from it makes it again;
    without, the tokens cost less where they are used once.
    """
    lines = F.split("text", "\n")
    if kept:
        cut = F.transform(lines, lambda raw: F.when(raw.rlike(r"\S"), tokens_of(F.trim(raw))))
        tokens = docs.select(*document_names(), F.posexplode(cut).alias("line", "w")).where("w is not null")
    else:
        rows = docs.select(*document_names(), F.posexplode(lines).alias("line", "raw")).where(F.col("raw").rlike(r"\S"))
        tokens = rows.select("d", "h", "line", tokens_of(F.trim("raw")).alias("w"))
    return tokens.withColumn("n", F.size("w")).withColumn("leaf", F.xxhash64("n", F.slice("w", 1, depth)))


#: SQL: a line's class.
CLASS = "xxhash64(n, w) as k"


def similar(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(k) for the pairs (k, o) of classes of one leaf that are similar."""
    other = known.select(F.col("k").alias("o"), F.col("leaf").alias("leaf_o"), F.col("t").alias("u"))
    met = pairs.distinct().join(known.select("k", "leaf", "t"), "k").join(other, "o").where("leaf = leaf_o and size(t) = size(u)")
    same = F.size(F.filter(F.zip_with("t", "u", lambda a, b: a == b), lambda x: x))
    return met.where(APART * same >= (APART - 1) * F.size("t")).select("k").distinct()


def bands(tokens: str, n: str, of: str) -> str:
    """SQL: hashes of the n div APART + 1 bands that an array of tokens is cut into, with what they belong to."""
    count = f"({n} div {APART} + 1)"
    begin, end = f"int(size({tokens}) * i div {count})", f"int(size({tokens}) * (i + 1) div {count})"
    return f"transform(sequence(0, int({n} div {APART})), i -> xxhash64({of}, i, slice({tokens}, {begin} + 1, {end} - {begin})))"


def rest(tokens: str, n: str, i: str) -> str:
    """SQL: the tokens without band i."""
    count = f"({n} div {APART} + 1)"
    return f"concat(slice({tokens}, 1, int(size({tokens}) * {i} div {count})), slice({tokens}, int(size({tokens}) * ({i} + 1) div {count}) + 1, size({tokens})))"


def among(rows: DataFrame, values: DataFrame) -> DataFrame:
    """The rows whose value, in the one column of values, is one of these, and a few others: a table of SLOTS bits in
    words of 64 tells before any row travels. With so many values that all bits are set nothing is held back."""
    slot = f"pmod(`{values.columns[0]}`, {SLOTS}L)"
    words = values.select(F.expr(slot).alias("slot")).groupBy(F.expr("slot div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, int(slot % 64)))").alias("_bits"))
    table = F.broadcast(settled(words))  # SLOTS / 64 rows at most, 1 MB
    here = rows.withColumn("_word", F.expr(f"{slot} div 64")).join(table, "_word")
    return here.where(f"getbit(_bits, int({slot} % 64)) = 1").drop("_word", "_bits")


def repeated(classes: DataFrame, docs: DataFrame, depth: int) -> DataFrame:
    """(k) of the classes that a similar class of a smaller document precedes."""
    long = classes.where(F.col("n") >= APART)
    shared = settled(long.groupBy("leaf").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).where("a < b").select("leaf"))
    wanted = among(long, shared).join(shared, "leaf").select("k", "lo")
    # The texts are read once more: tokens are kept of lines that have company in their leaf alone.
    known = among(tree(docs, depth, kept=True).where(F.col("n") >= APART), shared).selectExpr("d", "leaf", "n", CLASS, "transform(w, x -> hash(x)) as t")
    known = known.join(wanted, "k").where("d = lo").dropDuplicates(["k"]).select("k", "leaf", "lo", "n", "t")
    known = settled(known.withColumn("tail", F.expr(f"slice(t, {depth + 1}, n)")))
    cells = known.select("k", "lo", "n", F.posexplode(F.expr(bands("tail", "n", "leaf"))).alias("i", "b"))
    heads = cells.groupBy("b").agg(F.min("lo").alias("first"), F.max("lo").alias("last"), F.min_by("k", "lo").alias("o"), F.count("*").alias("size")).where("first < last")
    cells = written(cells.join(heads, "b").select("k", "lo", "n", "i", "b", "o", "first", "size"), "cells")
    gone = settled(similar(cells.where("lo > first").select("k", "o"), known))
    open_cells = cells.join(gone.withColumn("there", F.lit(True)), "k", "left").select("k", "lo", "n", "i", "b", "size", (F.col("there").isNull() & (F.col("lo") > F.col("first"))).alias("asks"))
    asked = open_cells.groupBy("b").agg(F.count_if("asks").alias("asking")).where("asking > 0")
    # Either way a band of m members makes m * (n div APART + 1) rows at most.
    direct = F.expr(f"size <= {SMALL_BAND} or asking <= n div {APART} + 1")
    open_cells = settled(open_cells.join(asked, "b").withColumn("direct", direct))
    large = open_cells.where("not direct").join(known.select("k", "tail"), "k").withColumn("rest", F.expr(rest("tail", "n", "i")))
    fine = large.select("k", "lo", "asks", F.explode(F.expr(bands("rest", "n", "b"))).alias("b")).unionByName(open_cells.where("direct").select("k", "lo", "asks", "b"))
    earlier = fine.select("b", F.col("k").alias("o"), F.col("lo").alias("lo_o"))
    return gone.union(similar(fine.where("asks").join(earlier, "b").where("lo_o < lo").select("k", "o"), known))


def dropped_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(d, h, lines): the numbers of the lines that go, by document."""
    docs = docs.select("doc_id", "text")
    lines = written(tree(docs, depth).selectExpr("d", "h", "line", "n", "leaf", CLASS), "lines")
    classes = written(lines.groupBy("k").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("leaf").alias("leaf"), F.min("n").alias("n")), "classes")
    # From which document on a class's lines go: after the first of its own, or all of them.
    again = classes.where("lo < hi").select("k", "lo").unionByName(repeated(classes, docs, depth).select("k", F.lit(None).cast("long").alias("lo")))
    after = settled(again.groupBy("k").agg(F.min("lo").alias("lo"), F.bool_or(F.col("lo").isNull()).alias("all")))
    gone = among(lines.select("d", "h", "line", "k"), after.select("k")).join(after, "k").where("all or d > lo")
    return gone.groupBy("d", "h").agg(F.collect_set("line").alias("lines"))


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs with recurring templates' lines dropped from text, and columns n_lines, n_dropped before any other
    change: the lines that the text had, and those that went."""
    gone = dropped_lines(docs, depth).select(F.col("d").alias("_gone_d"), F.col("h").alias("_gone_h"), F.col("lines").alias("_gone_lines"))
    here = docs.withColumns({"_line_d": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), "_line_h": F.xxhash64("text")})
    joined = here.join(gone, (F.col("_line_d") == F.col("_gone_d")) & (F.col("_line_h") == F.col("_gone_h")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("_gone_lines"), i)), "\n")
    text = F.when(F.col("_gone_lines").isNull(), F.col("text")).otherwise(left)
    return joined.select(*(text.alias(c) if c == "text" else joined[f"`{c}`"] for c in docs.columns), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"), F.coalesce(F.size("_gone_lines"), F.lit(0)).alias("n_dropped"))


ORACLE_SQL = """
with l as (
  select doc_id as d, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as raw from documents
), t as (
  select d, line, list_transform(string_split(trim(raw, ' '), ' '), lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) as t from l where regexp_matches(raw, '\\S')
), c as (select t, len(t) as n, t[1:2] as lead, min(d) as lo from t group by t),
r as (
  select distinct x.t from c x join c y on x.n = y.n and x.lead = y.lead and y.lo < x.lo and 5 * len(list_filter(list_zip(x.t, y.t), lambda p: p[1] = p[2])) >= 4 * x.n
), gone as (
  select t.d, t.line from t join c on c.t = t.t left join r on r.t = t.t where r.t is not null or t.d > c.lo
), rest as (
  select s.d, string_agg(s.x, chr(10) order by s.line) filter (where gone.line is null) as text, count(*) as n_lines, count(gone.line) as n_dropped
  from (select doc_id as d, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line, unnest(string_split(text, chr(10))) as x from documents) s
  left join gone on gone.d = s.d and gone.line = s.line group by s.d
)
select doc_id, case when documents.text is null then null else coalesce(rest.text, '') end as text, coalesce(n_lines, 0)::int as n_lines, coalesce(n_dropped, 0)::int as n_dropped
from documents left join rest on rest.d = doc_id
"""
