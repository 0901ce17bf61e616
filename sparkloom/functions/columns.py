"""Column expressions that several operators share. Everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Without white space at the ends; null where nothing is left."""
    return F.nullif(F.btrim(c, F.lit(" \t\n\x0b\x0c\r")), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, r"\s+", " ")


def number(c: Column) -> Column:
    """A plain decimal number as double; null for anything else, nan included."""
    text = F.trim(c)
    # of the letters that a cast takes, in nan or 1d, only those of an exponent are left
    return F.when(F.translate(text, "0123456789+-.eE", "") == "", text.try_cast("double"))


def drop_time(c: Column) -> Column:
    """y-M-d H:m:s as timestamp without time zone; null for anything else. Only texts of that shape are parsed."""
    usual, shaped = c.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), c.rlike(r"^\d+-\d+-\d+ \d+:\d+:\d+$")
    return F.when(usual, c.try_cast("timestamp_ntz")).when(shaped, F.try_to_timestamp(c, F.lit("y-M-d H:m:s")).cast("timestamp_ntz"))


def stock_code(c: Column) -> Column:
    """Five digits with a lower-case suffix, and the code m, in upper case; others as they are."""
    return F.when(c.rlike("^[0-9]{5}[a-z]+$") | (c == "m"), F.upper(c)).otherwise(c)


def formula_like(c: Column) -> Column:
    """A text that a spreadsheet would take for a formula."""
    return c.rlike("^[=+@]") | c.rlike("^-[^0-9.]")


def mask_digits(c: Column) -> Column:
    """Lower case, each run of digits as #."""
    return F.regexp_replace(F.lower(c), r"\d+", "#")


_AMOUNT = r"[-−–]?£?(?:GBP)?[-−–]?(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}"
_WHOLE = r"[-−–]?(?:\d{1,3}(?:,\d{3})+|\d+)"


def _read_number(c: Column, shape: str, kind: str) -> Column:
    """What is printed in that shape, or in that shape in brackets, which makes it negative as a minus sign does; one pattern decides for texts that are none."""
    bare = F.replace(c, F.lit(" "), F.lit(""))
    value = F.regexp_replace(bare, "[^0-9.]", "").try_cast(kind)
    return F.when(bare.rlike(rf"^(?:\({shape}\)|{shape})$"), F.when(bare.rlike("[-−–(]"), -value).otherwise(value))


def money(c: Column) -> Column:
    """Pounds with two decimals as decimal(14,2); brackets and minus signs are negative; null for anything else."""
    return _read_number(c, _AMOUNT, "decimal(14,2)")


def row_key(*columns: Column) -> Column:
    """The first 32 hex digits of SHA-256 over the columns as text, null as empty, joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).cast("binary"), 256), 1, 32)


def row_hashes(columns: list[Column]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row's values and of where it has nulls: equal rows have equal ones."""
    parts = [*columns, *[c.isNull() for c in columns]]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def working_day(c: Column) -> Column:
    """The date itself, or the Monday after it at a weekend."""
    return F.when(F.weekday(c) >= 5, F.date_add(c, F.lit(7) - F.weekday(c))).otherwise(c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def held(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is worked out once, however often use names it, inside lambda functions as well."""
    return F.element_at(F.transform(F.array(c), use), 1)


def softmax(logits: Column) -> Column:
    """The probabilities of an array of logits; the largest is taken off first, so that none overflows. Null for an array
    that is null or empty or holds a null or a number that isn't finite."""

    def shares(x: Column) -> Column:
        usable = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
        weights = held(F.array_max(x), lambda most: F.transform(x, lambda v: F.exp(v - most)))
        whole = lambda w: F.aggregate(w, F.lit(0.0), lambda s, v: s + v)
        return F.when(usable, held(weights, lambda w: held(whole(w), lambda n: F.transform(w, lambda v: v / n))))

    return held(logits.cast("array<double>"), shares)


def top_k(p: Column, k: int = 5) -> Column:
    """array<struct<label, p>>: the k largest of an array with their places from 0, ties by the smaller place."""
    places = F.transform(p, lambda x, i: F.struct((-x).alias("d"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(places), 1, k), lambda s: F.struct(s["i"].alias("label"), (-s["d"]).alias("p")))


def json_safe(c: Column) -> Column:
    """A number that JSON can hold: null for one that isn't finite."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def safe_json(df: DataFrame) -> Column:
    """All columns of df as a JSON object with nulls kept; numbers that aren't finite are null, in arrays as well; times and
    decimals are texts."""

    def put(f):
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("float", "double"):
            return json_safe(c)
        if kind in ("array<float>", "array<double>"):
            return F.transform(c, json_safe)
        return c.cast("string") if kind.startswith(("decimal", "timestamp", "date")) else c

    return F.to_json(F.struct(*[put(f).alias(f.name) for f in df.schema.fields]), {"ignoreNullFields": "false"})


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """The rank round(q * (n - 1)), halves to even, among n values counted from 0."""
    return lambda n: F.bround(F.lit(q) * (n - 1)).cast("long")


def floor_rank(q: float) -> Callable[[Column], Column]:
    """The rank floor(q * n), the last at most."""
    return lambda n: F.least(n - 1, F.floor(F.lit(q) * n)).cast("long")


def upper_median() -> Callable[[Column], Column]:
    """The rank n div 2."""
    return floor_rank(0.5)


def idf(n: Column, df: Column) -> Column:
    return F.log1p(n / (df + 1))


#: Suffixes in the order in which they are tried, what takes their place, and the least length of a word.
SUFFIXES = (("ies", "y", 5), ("sses", "ss", 6), ("ing", "", 6), ("ed", "", 5), ("es", "e", 5), ("s", "", 4))


def stem(c: Column) -> Column:
    """A light English suffix stemmer; possessive 's goes first, a word in ss stays."""
    return _without_suffix(_without_possessive(c))


def stems(words: Column) -> Column:
    """stem() of each word of an array. Two steps over it, as in a lambda function what is used several times is worked out each time."""
    return F.transform(F.transform(words, _without_possessive), _without_suffix)


def _without_possessive(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(c), "’", "'"), "'s$", "")


def _without_suffix(w: Column) -> Column:
    out = None
    for suffix, instead, least in SUFFIXES:
        fits, cut = w.endswith(suffix) & (F.length(w) >= least), F.concat(F.substring(w, F.lit(1), F.length(w) - len(suffix)), F.lit(instead))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return F.when(w.endswith("ss"), w).otherwise(out.otherwise(w))


def citations(c: Column) -> Column:
    """Numbers in [1], [2, 3] ... in order of first appearance."""
    groups = F.regexp_extract_all(c, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda x: x.cast("int")))


def checked_citations(c: Column, sources: Column) -> Column:
    """struct(valid, invented): the cited numbers from 1 to sources, and the others."""
    known = lambda n: (n >= 1) & (n <= sources)
    return F.struct(F.filter(citations(c), known).alias("valid"), F.filter(citations(c), lambda n: ~known(n)).alias("invented"))


def cut_passage(c: Column, most: int) -> Column:
    """A text of at most `most` characters as it is, a longer one cut at its last space within them, with a mark."""
    head = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit(" …")))


def code_text(c: Column) -> Column:
    """A code that a spreadsheet turned into a number, without its .0."""
    return F.regexp_replace(F.trim(c), r"\.0$", "")


def whole_number(c: Column) -> Column:
    """A printed quantity as long: thousands separators, brackets or a minus sign for negative ones; null for anything else."""
    return _read_number(c, _WHOLE, "long")


#: How printed dates may look, each with or without a time.
DATE_FORMATS = ("d/M/yyyy", "yyyy-M-d", "d MMMM yyyy", "d MMM yyyy", "d.M.yyyy", "d-MMM-yyyy")


def printed_date(c: Column) -> Column:
    """A printed date as timestamp without time zone; null for anything else."""
    text = F.regexp_replace(F.trim(c), r"\s+", " ")
    # a format that fails costs far more than a look at a text's shape, and most texts are no dates
    shaped, named, timed = text.rlike(r"^[-+]?\d+[-/. ][^-/. ]+[-/. ][-+]?\d"), text.rlike(r"\p{L}"), text.contains(":")
    own = lambda f: F.when(timed, F.try_to_timestamp(text, F.lit(f"{f} H:m"))).otherwise(F.try_to_timestamp(text, F.lit(f))).cast("timestamp_ntz")
    fits = lambda f: text.contains(f.strip("dMy")[0]) & (named if "MMM" in f else ~named)
    return F.when(shaped, F.coalesce(*[F.when(fits(f), own(f)) for f in DATE_FORMATS]))


def us_date(c: Column) -> Column:
    """A timestamp as month/day/year with a twelve-hour clock."""
    return F.date_format(c, "MM/dd/yyyy h:mm a")


def month_end(month: Column) -> Column:
    """The last day of a month given as yyyy-MM."""
    return F.last_day(F.to_date(F.concat(month, F.lit("-01"))))


def next_month(month: Column) -> Column:
    """The month after one given as yyyy-MM."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), 1), "yyyy-MM")


def plain_text(c: Column) -> Column:
    """Ligatures spelled out, control characters gone, runs of leader dots as a space."""
    out = c
    for one, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(one), F.lit(letters))
    return F.regexp_replace(F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"\s*\.(\s?\.){3,}\s*", " ")


def comparable(c: Column) -> Column:
    """Lower case with plain quotes and hyphens and single spaces, to look facts up in."""
    return F.regexp_replace(F.translate(F.lower(c), "’“”‐", "'\"\"-"), r"\s+", " ")


def facts_present(answer: Column, facts: Column) -> Column:
    """Whether of each fact (an array of ways to put it) one stands in the answer."""
    text = comparable(answer)
    return F.forall(facts, lambda ways: F.exists(ways, lambda way: F.contains(text, comparable(way))))


def highlights(c: Column, words: Column) -> Column:
    """array<struct<start, end>>: where whole words of the array stand in the text, letters in either case; end exclusive.

    The text is taken apart into words and what lies between; starts are the lengths of what came before.
    """
    pieces = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    kind = "struct<at: int, found: array<struct<start: int, end: int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("found")).cast(kind)

    def step(acc, piece):
        end = acc["at"] + F.length(piece)
        span = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.array_contains(words, F.lower(piece)), F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found")).cast(kind)

    return F.aggregate(pieces, zero, step, lambda acc: acc["found"])


def raw_json(columns: list[str]) -> Column:
    """Columns as a JSON object of texts, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})


def checked_vector(v: Column, size: int) -> Column:
    """The vector; an error where it isn't null and has another length."""
    return F.when(v.isNull() | (F.size(v) == size), v).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {size} numbers is needed, not of "), F.size(v).cast("string"))).cast("array<float>"))


def corrupted(rows: DataFrame, keys: list[str], seed: int, quantity: str, date: str, price: str) -> DataFrame:
    """rows with seeded faults for tests, by a hash of the keys: 4 % bad quantities, 2 % dates in another order, 1 % missing
    prices, 0.5 % cut lines (column cut)."""
    bucket = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary")), 1, 8), 16, 10).cast("long") % 1000
    out = rows.withColumn("_b", bucket)
    return out.withColumns({
        quantity: F.when(F.col("_b") < 40, "five").otherwise(F.col(quantity)), date: F.when((F.col("_b") >= 40) & (F.col("_b") < 60), us_date(F.col(date).try_cast("timestamp_ntz"))).otherwise(F.col(date)),
        price: F.when((F.col("_b") >= 60) & (F.col("_b") < 70), "").otherwise(F.col(price)), "cut": (F.col("_b") >= 70) & (F.col("_b") < 75),
    }).drop("_b")
