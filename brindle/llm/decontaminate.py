"""Benchmark decontamination by template windows, in DataFrame functions only.

Words become a template: numbers, capitalised words and units after a number are typed placeholders. Windows
of five template words are joined by hash with those of the benchmark that have three literal words at least.
Pairs that share enough of an item's windows are read again: at each alignment the windows must be equal as
templates, and every value of the item's slots must meet one value of the document's, so a question with
other numbers or names is caught and a chance meeting of placeholders is not. Beside the templates the windows of
the words themselves are joined, without regard to case, so a verbatim passage is found in whatever case it is
written; an item of fewer than five words is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.rows import carry_out, few, text_key
from brindle.session import scope, stash

WIDTH, LITERALS, SHARE = 5, 3, 0.8
BROADCAST_WINDOWS = 200_000  # of the benchmark; more are joined by a shuffle
UNITS = (
    "km m cm mm mi ft in yd kg g mg lb oz l ml gal h hr hrs hour hours min mins minute minutes s sec second seconds day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent mph kmh kph mile miles meter meters metre metres gram grams liter liters litre litres pound pounds degrees"
).split()


def raw_words(text: str | Column) -> Column:
    """Numbers, with their inner points, and runs of letters; null has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"\p{N}+(?:[.,:/]\p{N}+)*|[\p{L}\p{M}]+"), F.lit(0))


def _let(value: str, body: str) -> str:
    """SQL of body over the variable v, value being computed once: the optimizer can't copy it into body's lambdas."""
    return f"element_at(transform(array({value}), v -> {body}), 1)"


def template(words: str) -> Column:
    """The words of an array column with numbers as 0, capitalised words as N, and units after a number as U."""
    return F.expr(_template(words))


def _template(words: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    return _let(
        words, f"transform(v, (w, i) -> CASE WHEN w RLIKE '^\\\\p{{N}}' THEN '0' WHEN w RLIKE '^\\\\p{{Lu}}' THEN 'N' "
        f"WHEN w IN ({units}) AND i > 0 AND v[greatest(i - 1, 0)] RLIKE '^\\\\p{{N}}' THEN 'U' ELSE w END)")


def _hashes(words: str, width: int = WIDTH, salt: str = "") -> str:
    """SQL of the hash of each window of width words, in order; none for fewer words."""
    return _let(words, f"CASE WHEN size(v) >= {width} THEN transform(sequence(1, size(v) - {width - 1}), i -> xxhash64({salt}slice(v, i, {width}))) ELSE cast(array() AS array<bigint>) END")


def _folded(words: str, width: int = WIDTH) -> str:
    """SQL of the hash of each window of width words in one case; never that of a template window."""
    return _hashes(f"transform({words}, w -> lower(upper(w)))", width, "'verbatim', ")


def _verbatim(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, n, ipos, h, width) of the verbatim windows of items with a word; n is an item's number of them."""
    items = benchmark.select(F.col(item_col).alias("item_id"), raw_words(text_col).alias("iraw")).where("size(iraw) > 0").withColumn("width", F.least(F.size("iraw"), F.lit(WIDTH)))
    hashes = F.expr("CASE width " + " ".join(f"WHEN {k} THEN {_folded('iraw', k)}" for k in range(1, WIDTH + 1)) + " END")
    return items.withColumn("hs", hashes).select("item_id", F.size("hs").alias("n"), F.posexplode("hs").alias("ipos", "h"), "width")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, iraw, itpl, windows array<(ipos, h)>, n) of items that have a window."""
    items = benchmark.select(F.col(item_col).alias("item_id"), raw_words(text_col).alias("iraw")).withColumn("itpl", template("iraw")).withColumn("hs", F.expr(_hashes("itpl")))
    windows = F.expr(
        f"filter(transform(hs, (h, i) -> named_struct('ipos', i, 'h', h)), x -> "
        f"size(filter(slice(itpl, x.ipos + 1, {WIDTH}), w -> w NOT IN ('0', 'N', 'U'))) >= {LITERALS})")
    return items.withColumn("windows", windows).drop("hs").withColumn("n", F.size("windows")).where("n > 0")


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, containment, same_values): each document that holds an item, with the item.

    A document holds an item if `share` of the item's windows stand in it at alignments whose slots are
    consistent, or `share` of its verbatim windows in any case; same_values tells that no slot has another value or
    that all verbatim windows stand. Null and empty texts hold nothing, very long ones are read whole; items of fewer
    than five words, or with no template window of three literal words, are found verbatim only. Rows that repeat, and
    rows of one id that hold the same item, give one row for each id and item, the largest values; null ids are
    reported as null. No documents or no items give no rows. Other columns are not read, whatever their names.
    """
    with scope(docs.sparkSession) as sc:
        found = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, share)
        return sc.keep(found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"), F.max("same_values").alias("same_values")))


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, tkey, item_id, containment, same_values), several rows a document and item perhaps."""
    items = _items(benchmark, item_col, item_text_col)
    verbatim = _verbatim(benchmark, item_col, item_text_col)
    widths = sorted({WIDTH} | {r["width"] for r in verbatim.select("width").distinct().collect()})
    windows = items.select("item_id", "n", F.explode("windows").alias("x")).select("item_id", "n", "x.ipos", "x.h", F.lit(False).alias("verbatim"))
    windows = windows.unionByName(verbatim.select("item_id", "n", "ipos", "h", F.lit(True).alias("verbatim")))
    bounded = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    fit = F.broadcast if bounded else (lambda df: df)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text).alias("tkey"), text.alias("text"))
    # Template windows come first, so dpos is right for them; of verbatim windows it isn't used.
    both = F.expr(_let("raw", f"concat({_hashes(_template('v'))}, {', '.join(_folded('v', k) for k in widths)})"))
    seen = rows.withColumn("raw", raw_words("text")).select("doc_id", "tkey", F.posexplode(both).alias("dpos", "h"))
    hits = stash(seen.join(fit(windows), "h"))
    whole = hits.where("verbatim").groupBy("doc_id", "tkey", "item_id", "n").agg(F.countDistinct("ipos").alias("found")).where(F.col("found") >= share * F.col("n"))
    whole = whole.select("doc_id", "tkey", "item_id", (F.col("found") / F.col("n")).alias("containment"), (F.col("found") == F.col("n")).alias("same_values"))
    pairs = hits.where("NOT verbatim").groupBy("doc_id", "tkey", "item_id").agg(
        F.first("n").alias("n"), F.size(F.collect_set("ipos")).alias("found"), F.collect_set(F.struct("ipos", "dpos")).alias("at")).where(F.col("found") >= share * F.col("n"))
    # Only documents with a candidate are read again: their keys choose them before anything moves.
    pairs = stash(pairs.withColumnsRenamed({"doc_id": "p_id", "tkey": "p_key"}))
    keys = stash(pairs.select(F.col("p_id").alias("k_id"), F.col("p_key").alias("k_key")).distinct())
    some = rows.join(few(keys), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("tkey") == F.col("k_key")), "left_semi")
    again = some.join(pairs, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("tkey") == F.col("p_key"))).drop("p_id", "p_key")
    full = again.join(fit(items.select("item_id", "iraw", "itpl")), "item_id").withColumn("draw", raw_words("text")).withColumn("dtpl", template("draw"))
    cut = F.expr(
        f"element_at(transform(array(named_struct('d', draw, 't', dtpl)), v -> filter(transform(at, x -> named_struct('ipos', x.ipos, 'off', x.dpos - x.ipos, "
        f"'kind', slice(itpl, x.ipos + 1, {WIDTH}), 'a', slice(iraw, x.ipos + 1, {WIDTH}), 'b', slice(v.d, x.dpos + 1, {WIDTH}), 't', slice(v.t, x.dpos + 1, {WIDTH}))), "
        "w -> w.kind = w.t)), 1)")
    true = full.select("doc_id", "tkey", "item_id", "n", F.explode(cut).alias("w")).select("doc_id", "tkey", "item_id", "n", "w.*")
    slots = F.expr("filter(arrays_zip(kind, a, b), s -> s.kind IN ('0', 'N', 'U'))")
    aligned = true.groupBy("doc_id", "tkey", "item_id", "off").agg(
        F.first("n").alias("n"), F.collect_set("ipos").alias("ipos"), F.array_distinct(F.flatten(F.collect_list(slots))).alias("slots"))
    # An alignment with a slot value that meets two values is out.
    sound = aligned.where("size(slots) = size(array_distinct(transform(slots, s -> named_struct('kind', s.kind, 'a', s.a))))")
    same = F.expr("forall(slots, s -> s.a = s.b)")
    found = sound.groupBy("doc_id", "tkey", "item_id").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("ipos")))) / F.first("n")).alias("containment"), F.max(same).alias("same_values")).where(F.col("containment") >= share)
    return found.select("doc_id", "tkey", "item_id", "containment", "same_values").unionByName(whole)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item, with all columns as they were.

    A verdict holds for a row: rows that share an id but not the text don't fall together, and rows without an id fall
    by their text. All of repeated rows fall or stay. Null and empty texts stay. No rows give none, an empty benchmark
    gives all. Other columns may have any name.
    """
    with scope(docs.sparkSession) as sc:
        bad = sc.keep(_leaks(docs, benchmark, id_col, text_col).select("doc_id", "tkey", F.lit(True).alias("gone")).distinct())
    return carry_out(docs, bad, id_col, text_col)
