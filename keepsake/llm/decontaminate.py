"""Benchmark decontamination by templates: numbers, names and units become typed slots, windows are joined by hash.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.staging import staged

#: Units that may follow a number, in English, French, German and Spanish.
UNITS = (
    "km", "m", "cm", "mm", "miles", "mile", "feet", "foot", "ft", "inches", "inch", "yards", "kg", "g", "mg", "lb", "lbs", "pounds", "pound", "oz",
    "tons", "liters", "litres", "ml", "l", "gallons", "seconds", "second", "sec", "minutes", "minute", "min", "hours", "hour", "days", "day", "weeks",
    "week", "months", "month", "years", "year", "mph", "kmh", "percent", "dollars", "dollar", "cents", "euros", "euro", "degrees",
    "kilomètres", "kilomètre", "mètres", "mètre", "kilos", "kilo", "grammes", "litre", "tonnes", "secondes", "seconde", "heures", "heure", "jours", "jour",
    "semaines", "semaine", "mois", "ans", "année", "années", "degrés", "centimes", "Kilometer", "Meter", "Zentimeter", "Meilen", "Kilogramm", "Kilo", "Gramm",
    "Liter", "Tonnen", "Sekunden", "Sekunde", "Minuten", "Stunden", "Stunde", "Uhr", "Tage", "Tagen", "Tag", "Wochen", "Woche", "Monate", "Monaten", "Monat",
    "Jahre", "Jahren", "Jahr", "Prozent", "Grad", "Euro", "Cent", "kilómetros", "kilómetro", "metros", "metro", "millas", "kilogramos", "gramos", "litros",
    "toneladas", "segundos", "segundo", "minutos", "minuto", "horas", "hora", "días", "día", "semanas", "semana", "meses", "mes", "años", "año", "grados", "céntimos",
)
#: Numbers as words in the same languages; those that are articles, and Spanish eleven, which is an English adverb, are not taken.
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "dozen",
    "zéro", "deux", "trois", "quatre", "cinq", "sept", "huit", "neuf", "dix", "onze", "douze", "treize", "quatorze", "quinze", "seize", "vingt", "trente",
    "quarante", "cinquante", "soixante", "cent", "mille", "null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf",
    "dreizehn", "vierzehn", "fünfzehn", "sechzehn", "siebzehn", "achtzehn", "neunzehn", "zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig",
    "achtzig", "neunzig", "hundert", "tausend", "cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "doce", "trece",
    "catorce", "quince", "dieciséis", "diecisiete", "dieciocho", "diecinueve", "veinte", "veintiuno", "veintidós", "treinta", "cuarenta", "cincuenta", "sesenta",
    "setenta", "ochenta", "noventa", "cien", "ciento", "mil",
)
_NUMBER = r"([0-9][0-9·]*)"


def any_word(words: Sequence[str]) -> str:
    """A pattern for any of the words that tries each beginning once: alternatives part where the words do."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    end = heads.pop("", None)
    parts = "|".join(head + any_word(rest) for head, rest in heads.items())
    return f"(?:{parts})?" if parts and end else f"(?:{parts})" if len(heads) > 1 else parts


_UNIT, _NUMERAL = any_word(UNITS), any_word(NUMBER_WORDS)
#: What separates words once slots are marked.
_BETWEEN = r"[^\p{L}\p{N}\p{M}⟨⟩·]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` and lambdas in it use it.

    A plain column would be put in by the optimizer wherever it is used: into a lambda, for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def marked(text: Column) -> Column:
    """The text with each slot written as ``⟨type⟩value``: num, unit (after a number, or a currency sign), name.

    A number is digits or number words, several of which with spaces or hyphens between are one ("twenty-five",
    but not "two hundred and six" nor compounds like "dreiundzwanzig"). A name is a capitalised word inside a
    sentence, one that follows a small letter, digit, comma or semicolon and one space, with the capitalised
    words after it: "New York" is one. Points and commas inside numbers, and what is between the
    words of one slot, become a middle dot.

    Groups repeat possessively (``*+``): Java matches those in a loop, others by a call for each repetition, and
    a text with thousands of such words in a row overflows the stack, which ends the executor. No shorter run
    of words could match where the longest does not, so what is found is the same.
    """
    numeral = rf"(?iu)\b{_NUMERAL}\b"

    def by_words(plain: Column) -> Column:
        joined = F.regexp_replace(plain, rf"(?iu)\b({_NUMERAL})[ -](?={_NUMERAL}\b)", "$1·")
        return F.regexp_replace(joined, rf"(?iu)(?<![\p{{L}}\p{{N}}·])({_NUMERAL}(?:·{_NUMERAL})*+)(?![\p{{L}}\p{{N}}·])", " ⟨num⟩$1 ")

    def by_digits(plain: Column) -> Column:
        joined = F.regexp_replace(plain, r"(?<=[0-9])[.,:/](?=[0-9])", "·")
        return F.regexp_replace(F.regexp_replace(joined, _NUMBER, " ⟨num⟩$1 "), r"[$€£%]", " ⟨unit⟩$0 ")

    plain = let(text, lambda t: F.when(t.rlike("[⟨⟩·]"), F.translate(t, "⟨⟩·", "   ")).otherwise(t))
    worded = let(plain, lambda t: F.when(t.rlike(numeral), by_words(t)).otherwise(t))
    counted = let(worded, lambda t: F.when(t.rlike("[0-9$€£%]"), by_digits(t)).otherwise(t))
    with_units = let(counted, lambda t: F.when(t.contains("⟨num⟩"), F.regexp_replace(t, rf"(⟨num⟩[^ ⟨⟩]+) +({_UNIT})(?![\p{{L}}\p{{N}}])", "$1 ⟨unit⟩$2 ")).otherwise(t))
    named = F.regexp_replace(with_units, r"\p{Lu}(?<=[\p{Ll}\p{N},;⟩] \p{Lu})\p{L}*(?: \p{Lu}\p{L}*)*+", "⟨name⟩$0")
    # inside a name of several words alone a space stands before a capital
    return let(named, lambda t: F.when(t.rlike(r"⟨name⟩\p{L}+ \p{Lu}"), F.regexp_replace(t, r" (?=\p{Lu})(?<=⟨name⟩\p{L}[\p{L} ]{0,100} )", "·")).otherwise(t))


def words_of(marked_text: Column, values: bool) -> Column:
    """Lower-cased words; slots with their values, or as bare types (the template)."""

    def bare(text: Column) -> Column:
        return F.when(text.contains("⟨"), F.regexp_replace(text, r"(⟨[a-z]+⟩)[\p{L}\p{N}\p{M}·$€£%]*", "$1")).otherwise(text)

    shown = marked_text if values else let(marked_text, bare)
    return F.array_remove(F.split(F.lower(shown), r"[^\p{L}\p{N}\p{M}⟨⟩·$€£%]+" if values else _BETWEEN), "")


def window_hashes(words: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words; empty for shorter texts."""

    def hashes(w: Column) -> Column:
        return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<bigint>"))

    return let(words, hashes)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if a count shows that it has at most ``rows`` rows; else joined by a shuffle.

    For tables of a few numbers or single words a row, so the count bounds the bytes as well.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def item_classes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, member, w, v): every item with its words as template (w) and with values (v), and its class.

    Items of one class have the same template, and their slots are equal to each other at the same places, so
    one can't be told from another by a document with new values. ``item`` is the least of the class, of which
    ``member`` is one; an item id with several texts is a member by each. Null ids are left out.
    """
    told = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("member"), marked(F.coalesce(F.col(text), F.lit(""))).alias("m"))
    words = told.select("member", words_of(F.col("m"), False).alias("w"), words_of(F.col("m"), True).alias("v")).distinct()
    places = F.transform("v", lambda x: F.when(x.startswith("⟨"), F.array_position("v", x)).otherwise(F.lit(0)))
    keyed = words.withColumn("_k", F.xxhash64("w", places))
    return keyed.join(keyed.groupBy("_k").agg(F.min("member").alias("item")), "_k").select("item", "member", "w", "v")


def class_windows(items: DataFrame, size: int) -> DataFrame:
    """(item, at, window, n_windows): the classes' template windows with at least as many words as slots."""
    rows = items.select("item", "w", F.posexplode(window_hashes(F.col("w"), size)).alias("at", "window")).where(F.size(F.filter(F.slice("w", F.col("at") + 1, size), lambda x: x.startswith("⟨"))) * 2 <= size)
    solid = rows.select("item", "at", "window").distinct()
    return solid.join(solid.groupBy("item").agg(F.countDistinct("window").alias("n_windows")), "item")


def _bare(valued: Column) -> Column:
    """Valued words without the slots' types and bounds, which depend on what stands before."""
    return F.flatten(F.transform(valued, lambda x: F.split(F.regexp_replace(x, "⟨[a-z]+⟩", ""), "·")))


def _whole_items(docs: DataFrame, items: DataFrame, bench: DataFrame, doc_id: str, text: str, broadcast_rows: int) -> DataFrame | None:
    """(doc, item, n_items, n_slots) of the documents that hold, word for word, an item of which ``bench`` has no window; None without such items."""
    left = items.where(F.size("v") > 0).join(bench.select("item").distinct(), "item", "left_anti")
    shown = left.select("member", _bare(F.col("v")).alias("b"), F.size(F.filter("w", lambda x: x.startswith("⟨"))).alias("n_slots"))
    short = staged(shown.groupBy(F.size("b").alias("length"), F.xxhash64("b").alias("whole")).agg(F.min("member").alias("item"), F.countDistinct("member").alias("n_items"), F.max("n_slots").alias("n_slots")), "whole-items")
    lengths = sorted(r.length for r in short.select("length").distinct().collect())
    if not lengths:
        return None
    words = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), let(words_of(marked(F.col(text)), True), _bare).alias("v"))
    of_length = lambda k: F.transform(F.array_distinct(window_hashes(F.col("v"), k)), lambda h: F.struct(F.lit(k).alias("length"), h.alias("whole")))
    held = words.select("doc", F.explode(F.flatten(F.array(*[of_length(k) for k in lengths]))).alias("r")).select("doc", "r.length", "r.whole")
    return held.join(bounded(short, broadcast_rows), ["length", "whole"]).select("doc", "item", "n_items", "n_slots").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 8, share: float = 0.5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_rows: int = 2_000_000) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers, names and units in its slots.

    Items are taken by classes (``item_classes``): re-parameterised versions of one question are one item
    here, so their number does not multiply the result. A document is a candidate for an item if it has
    ``share`` of the item's template windows of ``size`` words. It is found if so many match with a member's
    values too. Else the slots decide: at one of the distances between the two texts that have the share (or
    at the most frequent, if none has), equal values of the item must stand for equal values of the document,
    and different for different, else the candidate goes.

    The benchmark's windows (rows of numbers) are broadcast after a count; beyond ``broadcast_rows`` they are
    joined by a shuffle. All windows of all documents take part, whole texts. The second step reads only the
    candidates' texts, by a join on the id that is broadcast under the same bound. Items without a window
    (shorter than ``size`` words, or more slots than words all along: such templates fit too much to be
    trusted) are found where they stand word for word, values included, by the hash of the whole item: one
    pass for each of their lengths; they count as one window, and equal ones as one item. Null or empty texts
    match nothing; null ids are left out. Rows that repeat an id count together. Empty tables give no rows.

    Returns doc_id, item_id (the least of the class), n_items (members of the class), n_windows (of the item),
    n_matched, n_slots (aligned), kind: ``exact`` (all that matched has a member's values) or
    ``reparameterised``.
    """
    items = staged(item_classes(benchmark, item_id, item_text), "items")
    bench = staged(class_windows(items, size), "benchmark-windows")
    hashed = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.explode(window_hashes(words_of(marked(F.col(text)), False), size)).alias("window"))
    keys = bench.select("window", "item", "n_windows").distinct()
    met = hashed.join(bounded(keys, broadcast_rows), "window").groupBy("doc", "item", "n_windows").agg(F.countDistinct("window").alias("n_matched"))
    need = F.greatest(F.lit(1), F.ceil(F.col("n_windows") * share))
    candidates = staged(met.where(F.col("n_matched") >= need), "candidates")

    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("_t")).join(bounded(candidates.select("doc").distinct(), broadcast_rows), "doc", "left_semi").distinct()
    theirs = texts.select("doc", marked(F.col("_t")).alias("m")).select("doc", words_of(F.col("m"), False).alias("w"), words_of(F.col("m"), True).alias("v"))
    places = bounded(bench.select("item", F.col("at").alias("i_at"), "window"), broadcast_rows)
    at_docs = theirs.select("doc", "v", F.posexplode(window_hashes(F.col("w"), size)).alias("d_at", "window")).join(bounded(candidates, broadcast_rows), "doc").join(places, ["item", "window"])
    aligned = staged(at_docs.select("doc", "item", "n_windows", "n_matched", (F.col("d_at") - F.col("i_at")).alias("shift"), "i_at", "window", F.slice("v", F.col("d_at") + 1, size).alias("dv")), "aligned")
    pair, at_shift = ["doc", "item", "n_windows", "n_matched"], ["doc", "item", "shift"]
    shifts = aligned.groupBy(*pair, "shift").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("window").alias("n_here"))
    most = shifts.groupBy("doc", "item").agg(F.max("n").alias("most"))
    judged_shifts = staged(shifts.join(most, ["doc", "item"]).where((F.col("n_here") >= need) | (F.col("n") == F.col("most"))).drop("most", "n_here"), "shifts")
    valued = items.select("item", F.posexplode(window_hashes(F.col("v"), size)).alias("i_at", "own")).distinct()
    verbatim = aligned.withColumn("own", F.xxhash64("dv")).join(bounded(valued, broadcast_rows), ["item", "i_at", "own"], "left_semi").groupBy("doc", "item").agg(F.countDistinct("window").alias("n_exact"))
    cells = (
        aligned.select(*at_shift, F.posexplode("dv").alias("o", "dval"), "i_at").where(F.col("dval").startswith("⟨"))
        .join(judged_shifts.select(*at_shift), at_shift)
        .select(*at_shift, (F.col("i_at") + F.col("o")).alias("place"), "dval").distinct()
    )
    # the slots of one member stand for all: they are equal to each other at the same places
    ours = items.where("item = member").groupBy("item").agg(F.min("v").alias("v")).select("item", F.posexplode("v").alias("place", "ival")).where(F.col("ival").startswith("⟨"))
    slots = cells.join(bounded(ours, broadcast_rows), ["item", "place"]).select(*at_shift, "dval", "ival")
    forward = slots.groupBy(*at_shift, "ival").agg(F.countDistinct("dval").alias("to"), F.count(F.lit(1)).alias("n_slots")).groupBy(*at_shift).agg(F.max("to").alias("to"), F.sum("n_slots").alias("n_slots"))
    backward = slots.groupBy(*at_shift, "dval").agg(F.countDistinct("ival").alias("from")).groupBy(*at_shift).agg(F.max("from").alias("from"))
    judged = judged_shifts.join(forward, at_shift, "left").join(backward, at_shift, "left").select(
        *pair, F.struct(F.expr("coalesce(`to`, 1) = 1 and coalesce(`from`, 1) = 1").alias("fits"), "n", (-F.col("shift")).alias("back"), F.coalesce("n_slots", F.lit(0)).alias("n_slots")).alias("s")
    ).groupBy(*pair).agg(F.max("s").alias("s")).join(verbatim, ["doc", "item"], "left")
    exact, long = F.coalesce("n_exact", F.lit(0)), "long"
    sizes = items.groupBy("item").agg(F.countDistinct("member").alias("n_items"))
    found = judged.where(F.col("s.fits") | (exact >= need)).join(bounded(sizes, broadcast_rows), "item").select(
        F.col("doc").alias(doc_id), F.col("item").alias(item_id), "n_items", F.col("n_windows").cast(long), F.col("n_matched").cast(long), F.col("s.n_slots").cast(long).alias("n_slots"),
        F.when(~F.col("s.fits") | (exact >= F.col("n_matched")), "exact").otherwise("reparameterised").alias("kind"),
    )
    whole = _whole_items(docs, items, bench, doc_id, text, broadcast_rows)
    if whole is None:
        return found
    one = F.lit(1).cast(long)
    return found.unionByName(whole.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "n_items", one.alias("n_windows"), one.alias("n_matched"), F.col("n_slots").cast(long).alias("n_slots"), F.lit("exact").alias("kind")))
