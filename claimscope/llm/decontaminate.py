"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, units and names become typed placeholders; windows of eight template words are hash-joined between texts and
benchmark items; along each alignment, one value of the item must always stand for one value of the text. So an item
is found word for word, and also with other numbers, units and names put in. Windows that are mostly placeholders would fit
too much; they are joined by their own words instead of their types, and so are short items as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import written

WINDOW = 8  # template words
NEEDED = 6  # windows in line, so 13 words; an item with fewer windows needs all of them
LITERALS = 4  # words in a window that must not be placeholders; windows with fewer are joined by their own words
SHORT = 5  # words of an item that are enough to find it word for word within a longer text
BROADCAST_ROWS = 1_000_000  # item windows, of some 50 bytes each, that are broadcast at most
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"  # private-use characters stand for the types
# Spelled-out numbers and units of measure.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
)
UNITS = (
    "km kilometers kilometres kilometer kilometre meters metres meter metre cm centimeters centimetres mm millimeters "
    "mile miles yard yards foot feet inch inches kg kilograms kilogram gram grams mg pound pounds lb lbs ounce ounces oz "
    "liter liters litre litres ml gallon gallons second seconds minute minutes hour hours day days week weeks month months "
    "year years dollar dollars cent cents euro euros percent degree degrees mph kmh"
)


def _any_of(words: str) -> str:
    """The words as a pattern, longest first, by first letter, so that most places of a text fail at once."""
    letters: dict[str, list[str]] = {}
    for word in sorted(words.split(), key=len, reverse=True):
        letters.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in letters.items()) + ")"


def _bare(text: Column) -> Column:
    """Lower case, and only letters, digits, placeholders and white space."""
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}{NAME}{UNIT}\s]+", "")


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda word: word != "")


def _clean(text: Column) -> Column:
    """The text without characters that serve as placeholders; a null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT, "")


def template(text: Column) -> Column:
    """Template words of a text. A name is a capitalised word within a sentence; a unit follows a number."""
    # Each pattern begins with one character, for which a text is searched fast; what must stand before it is looked at after that.
    named = F.regexp_replace(_clean(text), r"\p{Lu}(?<=[^.!?:\s][ \t]\p{Lu})\p{Ll}+", NAME)
    begins = "".join(sorted({word[0] for word in NUMBER_WORDS.split()}))
    numbered = F.regexp_replace(
        F.lower(named), rf"(?=[{begins}\p{{N}}])(?<!\p{{L}})(?:\p{{N}}+(?:[.,:/]\p{{N}}+)*|{_any_of(NUMBER_WORDS)}(?!\p{{L}}))", NUMBER
    )
    united = F.regexp_replace(numbered, rf"{NUMBER}([ -]?){_any_of(UNITS)}(?!\p{{L}})", f"{NUMBER}$1{UNIT}")
    return _split(_bare(united))


def values(text: Column) -> Column:
    """The words of a text at the places of its template words."""
    return _split(_bare(F.lower(_clean(text))))


def _is_slot(word: Column) -> Column:
    return word.contains(NUMBER) | word.contains(NAME) | word.contains(UNIT)


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _starts(words: Column, length: int) -> Column:
    """Places, from 0, of all windows of that length; a text shorter than a window is one, a text without words has none."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - length))).otherwise(_none("int"))


def _own(values: Column, at: Column, length: int | Column) -> Column:
    """Hash of a window's own words, apart from all hashes of templates."""
    return F.xxhash64(F.lit("own"), F.lit(length) if isinstance(length, int) else length, F.slice(values, at + 1, length))


def _dense(words: Column, slots: Column) -> Column:
    """Places of the windows with fewer than ``LITERALS`` words that aren't placeholders; ``slots`` are the placeholders' places.

    Such a window holds ``WINDOW - LITERALS + 1`` placeholders in a row of them, so only those rows are looked at.
    """
    many = WINDOW - LITERALS + 1
    rows = F.when(F.size(slots) >= many, F.sequence(F.lit(0), F.size(slots) - many)).otherwise(_none("int"))
    close = F.filter(rows, lambda k: F.get(slots, k + (many - 1)) - F.get(slots, k) < WINDOW)
    around = F.transform(close, lambda k: F.sequence(
        F.greatest(F.lit(0), F.get(slots, k + (many - 1)) - (WINDOW - 1)), F.least(F.get(slots, k), F.size(words) - WINDOW)
    ))
    return F.when(F.size(words) >= WINDOW, F.array_distinct(F.flatten(around))).otherwise(_none("int"))


def _slots(words: Column) -> Column:
    return F.filter(F.transform(words, lambda word, i: F.when(_is_slot(word), i)), lambda i: i.isNotNull())


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, item_at, whole, hash, n_windows, item_template, item_values) for all windows of each item.

    A window goes by its template, or by its own words where fewer than ``LITERALS`` (or half of a shorter item's words) aren't
    placeholders. An item of ``SHORT`` words to fewer than ``NEEDED`` windows has one more entry, by all its own words; that one is ``whole``.
    """
    known = items.select("item_id", F.col("text").alias("item_text")).distinct().select(
        "item_id", template(F.col("item_text")).alias("item_template"), values(F.col("item_text")).alias("item_values")
    )
    words, own, size = F.col("item_template"), F.col("item_values"), F.size("item_template")
    known = written(known.where(size > 0)).withColumn("slots", _slots(words)).withColumn("dense", _dense(words, F.col("slots")))
    few = (size < WINDOW) & (size - F.size("slots") < F.ceil(size / 2))
    each = F.transform(_starts(words, WINDOW), lambda p: F.struct(
        p.alias("item_at"), F.lit(False).alias("whole"),
        F.when(few | F.array_contains(F.col("dense"), p), _own(own, p, WINDOW)).otherwise(F.xxhash64(F.slice(words, p + 1, F.lit(WINDOW)))).alias("hash"),
    ))
    short = (size >= SHORT) & (size < WINDOW + NEEDED - 1)
    entire = F.when(short, F.array(F.struct(F.lit(0).alias("item_at"), F.lit(True).alias("whole"), _own(own, F.lit(0), F.size(own)).alias("hash"))))
    return known.select(
        "item_id", F.size(each).cast("long").alias("n_windows"), "item_template", "item_values",
        F.inline(F.concat(each, F.coalesce(entire, F.array().cast("array<struct<item_at:int,whole:boolean,hash:bigint>>")))),
    )


def _with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row: as a generator's output, they aren't put into the expressions that use them."""
    row = F.explode_outer(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    return df.select("*", row.alias("_once")).select(*df.columns, "_once.*")


def _keys(words: Column, own: Column, dense: Column, lengths: list[int]) -> Column:
    """(at, hash) of a text's windows: by template, by own words where an item's window would be, and by own words at each of ``lengths``."""
    def keys(places: Column, hashed) -> Column:
        return F.transform(places, lambda p: F.struct(p.alias("at"), hashed(p).alias("hash")))

    few = F.when((F.size(words) > 0) & (F.size(words) < WINDOW), F.array(F.lit(0))).otherwise(dense)
    found = [keys(_starts(words, WINDOW), lambda p: F.xxhash64(F.slice(words, p + 1, F.lit(WINDOW)))), keys(few, lambda p: _own(own, p, WINDOW))]
    for n in lengths:
        places = F.when(F.size(own) >= n, F.sequence(F.lit(0), F.size(own) - n)).otherwise(_none("int"))
        found.append(keys(places, lambda p, n=n: _own(own, p, n)))
    return F.concat(*found)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, item_windows, n_slots, n_changed) for each text that repeats an item.

    A text repeats an item when ``NEEDED`` windows (or all of the item's, if fewer) match in line and the slots are consistent;
    the best line of each pair is given. ``n_changed`` of 0 means word for word. An item of at least ``SHORT`` words and too few windows is also
    found word for word anywhere in a text; one shorter than a window otherwise only matches a text that has the same template as a whole,
    and one of fewer than ``SHORT`` words only as a whole. Very long texts are read whole. Null and empty texts and items match nothing; a null doc_id or item_id is
    kept; repeated rows give one result; tables without rows give no rows; other columns are not read.
    """
    windows = written(item_windows(items))
    small = windows.count() <= BROADCAST_ROWS
    lengths = sorted(row["n"] for row in windows.where("whole").select(F.size("item_values").alias("n")).distinct().collect())
    pruned = windows.select("item_id", F.xxhash64("item_values").alias("item_hash"), "item_at", "whole", "hash", F.col("n_windows").alias("item_windows"))
    worded = _with_once(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), words=template(F.col("text")))
    worded = _with_once(_with_once(worded, slots=_slots(F.col("words"))), dense=_dense(F.col("words"), F.col("slots")))
    literal = (F.size("dense") > 0) | (F.size("words") < WINDOW) | F.lit(bool(lengths))  # of other texts, no window goes by its own words
    worded = _with_once(worded, own=F.when(literal, values(F.col("text"))).otherwise(_none("string")))
    hashed = worded.select("doc_id", "text_hash", _keys(F.col("words"), F.col("own"), F.col("dense"), lengths).alias("keys"))
    # The outer form: for the inner one, Spark filters by the array's size first, and works out the words anew in each element.
    placed = hashed.select("doc_id", "text_hash", F.explode_outer("keys").alias("key")).select("doc_id", "text_hash", "key.*")
    hits = placed.join(F.broadcast(pruned) if small else pruned, "hash")
    lines = written(
        hits.groupBy("doc_id", "text_hash", "item_id", "item_hash", "item_windows", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.count_distinct("at").alias("n"), F.min("item_at").alias("low"), F.max("item_at").alias("high"), F.max("whole").alias("whole"))
        .withColumn("n_windows", F.when(F.col("whole"), F.col("item_windows")).otherwise(F.col("n")))
        .withColumn("high", F.when(F.col("whole"), (F.col("item_windows") - 1).cast("int")).otherwise(F.col("high")))
        .where(F.col("n_windows") >= F.least(F.lit(NEEDED), F.col("item_windows")))
    )
    once = windows.select(F.col("item_id").alias("i"), F.xxhash64("item_values").alias("ih"), "item_template", "item_values").distinct()
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    met = texts.join(lines, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")))
    met = met.select(*lines.columns, template(F.col("text")).alias("words"), values(F.col("text")).alias("own")).join(
        F.broadcast(once) if small else once,
        F.col("i").eqNullSafe(F.col("item_id")) & (F.col("ih") == F.col("item_hash")),
    )
    # Places of the item that the line covers and where both have the same placeholder.
    covered = F.sequence(F.col("low"), F.least(F.col("high") + WINDOW, F.size("item_template")) - 1)
    slots = F.filter(
        F.transform(covered, lambda p: F.struct(
            F.get("item_template", p).alias("kind"), F.get("words", p + F.col("shift")).alias("met"),
            F.get("item_values", p).alias("given"), F.get("own", p + F.col("shift")).alias("found"),
        )),
        lambda x: _is_slot(x["kind"]) & (x["kind"] == x["met"]),
    )
    judged = met.withColumn("slots", slots).withColumn(
        "pairs", F.array_distinct(F.transform("slots", lambda x: F.struct(x["given"].alias("given"), x["found"].alias("found"))))
    )
    kept = judged.where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["given"])))).select(
        "doc_id", "text_hash", "item_id", "n_windows", F.col("item_windows").cast("long"), F.size("slots").cast("long").alias("n_slots"),
        F.size(F.filter("slots", lambda x: x["given"] != x["found"])).cast("long").alias("n_changed"),
    )
    best = F.max(F.struct("n_windows", (-F.col("n_changed")).alias("unchanged"), "n_slots", "item_windows"))
    return kept.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b")).select(
        "doc_id", "text_hash", "item_id", "b.n_windows", "b.item_windows", "b.n_slots", (-F.col("b.unchanged")).alias("n_changed")
    )


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that repeat no item, with the columns of ``docs``; cases as in ``leaks``."""
    found = written(leaks(docs, items)).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    return rows.join(found, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_h")), "left_anti").select("_row.*")
