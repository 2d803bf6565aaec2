"""Secrets in texts: known forms, and random strings that a battery of tests tells from words. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwitable.session import materialise

# The known forms.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_ID = r"AKIA[A-Z0-9]{14,}"  # those of ACCESS_LEAST characters
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that have 16 characters
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,6}"
# The alphabets of the encodings.
ALPHABETS = {
    "hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: The chance that two characters of an ordinary string are equal is at least this: digits alone have 1/10, letters of one case
#: in even use 1/26, and those of words about 1/15.
EQUAL = {"hex": 0.1, "base32": 0.05, "base62": 0.05, "base64": 0.05, "base64url": 0.05}
#: Lengths at which a band of strings of similar length begins.
BANDS = (16, 24, 32, 48, 96)
MOST_TENTHS = 400
#: Sums are carried from one block of matches to the next.
BLOCK = 64


def _running(values: str) -> Column:
    """Running sums of an array column: within blocks, and from block to block."""
    count = F.ceil(F.size(values) / BLOCK).cast("int")
    total = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.aggregate(
        F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda x, y: x + y))
    before = F.aggregate(total, F.array(F.lit(0)), lambda x, y: F.concat(x, F.array(F.element_at(x, -1) + y)))
    nested = F.transform(F.slice(before, F.lit(1), count), lambda carried, b: F.transform(
        F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), lambda _, j: carried + F.aggregate(
            F.slice(values, b * BLOCK + 1, j + 1), F.lit(0), lambda x, y: x + y)))
    return F.when(F.size(values) > 0, F.flatten(nested)).otherwise(F.array().cast("array<int>"))


def _located(docs: DataFrame, kind: str, pattern: str) -> DataFrame:
    """Adds ``kind``, an array of ``(start, end, found)``: the matches of a pattern with their places in code points."""
    hits, steps, ends = f"{kind}_hits", f"{kind}_steps", f"{kind}_ends"
    some = F.col("text").rlike(pattern)
    docs = docs.withColumn(hits, F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    gaps = F.when(F.size(hits) > 0, F.slice(F.split("text", pattern, -1), F.lit(1), F.size(hits))).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn(steps, F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)))
    docs = docs.withColumn(ends, _running(steps))
    return docs.withColumn(kind, F.zip_with(ends, hits, lambda e, h: F.struct(
        (e - F.length(h)).alias("start"), e.alias("end"), h.alias("found")))).drop(hits, steps, ends)


def _upper_tail(z: Column) -> Column:
    """The chance that a normal variable exceeds ``z``; the relative error stays below a half far out."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _noncentral_tail(x: Column, freedom: Column, shift: Column) -> Column:
    """The chance that a noncentral chi-squared variable is at most ``x``, by Sankaran's power of it that is nearly normal."""
    mean, double, triple = freedom + shift, freedom + 2 * shift, freedom + 3 * shift
    h = 1 - 2 * mean * triple / (3 * double * double)
    p = double / (mean * mean)
    m = (h - 1) * (1 - 3 * h)
    centre = 1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p)
    z = (F.pow(F.greatest(x, F.lit(0.0)) / mean, h) - centre) / (h * F.sqrt(2 * p) * (1 + 0.5 * m * p))
    return _upper_tail(-z)


def encoding(body: Column) -> Column:
    """The narrowest encoding whose alphabet has all characters of a string that mixes letters with digits, or cases; else NULL."""
    mixed = (body.rlike("[a-z]").cast("int") + body.rlike("[A-Z]").cast("int") + body.rlike("[0-9]").cast("int")) >= 2
    plain = ~body.rlike(r"[+/_-]")
    return F.when(mixed & body.rlike("^([0-9A-F]+|[0-9a-f]+)$"), "hex").when(mixed & body.rlike("^[A-Z2-7]+$"), "base32") \
        .when(mixed & plain, "base62").when(mixed & ~body.rlike("[_-]"), "base64").when(mixed & ~body.rlike("[+/]"), "base64url")


def _with(tokens: Column, **fields) -> Column:
    """An array of structs with more fields, each a function of the struct."""

    def extend(t: Column) -> Column:
        new = t
        for name, value in fields.items():
            new = new.withField(name, value(t))
        return new

    return F.transform(tokens, extend)


def _sum(values: Column, value) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + value(v))


def _sum_of_neighbours(values: Column, value) -> Column:
    """The sum of a function of each value and the next; one pass, so that a string of any length takes time in proportion."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(values, start, lambda s, v: F.struct(
        v.alias("last"), (s["sum"] + F.coalesce(F.when(s["last"].isNotNull(), value(s["last"], v)), F.lit(0.0))).alias("sum")), lambda s: s["sum"])


def battery(tokens: Column) -> Column:
    """Tests of an array of ``(start, end, found)``, of which strings without an encoding are left out.

    Adds ``encoding``, ``p_even``, ``p_runs`` and ``p_serial``. ``p_even`` is the chance that an ordinary string, whose
    characters coincide as often as ``EQUAL`` says, is as evenly spread over the alphabet as this one: chi-squared against
    uniformity, under the noncentral distribution that such a string of this length follows. A short string cannot get a
    small one. ``p_runs`` and ``p_serial`` are two-sided chances that a random string has as odd a number of runs in the
    upper and lower half of the alphabet, and as large a correlation of neighbours.
    """
    alphabet = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    equal = F.create_map(*[F.lit(x) for kv in EQUAL.items() for x in kv])
    number = lambda flag: F.when(flag, 1.0).otherwise(0.0)
    tokens = _with(tokens, body=lambda t: F.regexp_replace(t["found"], "=+$", ""))
    tokens = F.filter(_with(tokens, encoding=lambda t: encoding(t["body"])), lambda t: t["encoding"].isNotNull())
    tokens = _with(tokens, body=lambda t: F.when(t["encoding"] == "hex", F.upper(t["body"])).otherwise(t["body"]),
                   alphabet=lambda t: F.element_at(alphabet, t["encoding"]))
    tokens = _with(
        tokens, n=lambda t: F.length(t["body"]).cast("double"), k=lambda t: F.length(t["alphabet"]).cast("double"),
        x=lambda t: F.transform(F.filter(F.split(t["body"], ""), lambda c: c != ""), lambda c: (F.instr(t["alphabet"], c) - 1).cast("double")),
        squares=lambda t: _sum(F.sequence(F.lit(1), F.length(t["alphabet"])), lambda i: F.pow(
            F.length(t["body"]) - F.length(F.replace(t["body"], F.substr(t["alphabet"], i, F.lit(1)), F.lit(""))), F.lit(2.0))))
    tokens = _with(
        tokens, mean=lambda t: _sum(t["x"], lambda v: v) / t["n"],
        upper=lambda t: _sum(t["x"], lambda v: number(v * 2 >= t["k"])))
    tokens = _with(
        tokens, runs=lambda t: 1 + _sum_of_neighbours(t["x"], lambda a, b: number((a * 2 >= t["k"]) != (b * 2 >= t["k"]))),
        product=lambda t: _sum_of_neighbours(t["x"], lambda a, b: (a - t["mean"]) * (b - t["mean"])),
        spread=lambda t: _sum(t["x"], lambda v: (v - t["mean"]) * (v - t["mean"])),
        expected=lambda t: 2 * t["upper"] * (t["n"] - t["upper"]) / t["n"])
    tokens = _with(
        tokens, flat=lambda t: (t["spread"] == 0) | (t["upper"] == 0) | (t["upper"] == t["n"]),
        z_runs=lambda t: (t["runs"] - t["expected"] - 1) / F.sqrt(
            F.greatest(t["expected"] * (t["expected"] - 1) / (t["n"] - 1), F.lit(1e-9))),
        z_serial=lambda t: (t["product"] / F.greatest(t["spread"], F.lit(1e-9)) + 1 / t["n"]) * F.sqrt(t["n"]))
    return F.transform(tokens, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["found"].alias("found"), t["encoding"].alias("encoding"),
        _noncentral_tail(t["k"] * t["squares"] / t["n"] - t["n"], t["k"] - 1,
                         t["n"] * (t["k"] * F.element_at(equal, t["encoding"]) - 1)).alias("p_even"),
        F.when(t["flat"], 0.0).otherwise(F.least(F.lit(1.0), 2 * _upper_tail(F.abs(t["z_runs"])))).alias("p_runs"),
        F.when(t["flat"], 0.0).otherwise(F.least(F.lit(1.0), 2 * _upper_tail(F.abs(t["z_serial"])))).alias("p_serial")))


def limits(tokens: DataFrame, rate: float) -> dict[int, int]:
    """For each band of lengths the tenths of ``-log10(p)`` from which strings are found random.

    Among strings of similar length the share of ordinary ones in what is found is held below ``rate`` (Benjamini and
    Hochberg, in steps of a tenth). Each string counts once, however often it occurs. Bands keep the many short strings,
    which prove little, from hiding the long ones. A band without a discovery is left out.
    """
    counted = tokens.select("name", "band", "tenths").distinct().groupBy("band", "tenths").count()  # at most 5 x 401 rows
    beyond = "sum(count) over (partition by band order by tenths desc rows unbounded preceding)"
    whole = "sum(count) over (partition by band)"
    enough = counted.selectExpr("band", "tenths", f"{whole} * pow(10D, -tenths / 10D) <= {rate}D * {beyond} as enough")
    return {r["band"]: r["limit"] for r in enough.where("enough").groupBy("band").agg(F.min("tenths").alias("limit")).collect()}


def secrets(docs: DataFrame, rate: float = 0.01, odd: float = 0.001) -> DataFrame:
    """Every document with its secrets: ``(doc_id, base, added)``, arrays of ``(start, kind, end)`` in code points.

    ``base`` has the known forms, sorted by start and then kind (numbered as in ``KINDS``): an assignment to a name like
    password or token with a value of at least 12 characters, an access key id, and 16 or more lower-case hexadecimal digits.
    ``added`` has other strings of 16 or more characters that touch no known form and that the test battery finds random: an
    encoding is inferred, the string is too even to be ordinary (``limits``), and neither its runs nor its neighbours are
    odder than a random string's are with chance ``odd``.

    A null text counts as empty; without a match the arrays are empty. Repeated rows and null doc_ids stay, each row on its
    own. An empty table gives an empty result; other columns are ignored. Which strings are added depends on all strings
    of the input.
    """
    found = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("tokens", TOKEN)):
        found = _located(found, kind, pattern)

    def kept(kind: str, least: int, size) -> Column:
        return F.transform(F.filter(kind, lambda x: size(x["found"]) >= least), lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))

    value = lambda x: F.length(F.regexp_extract(x, ASSIGN, 2))
    found = found.select(
        "doc_id", "tokens", kept("assign", ASSIGN_LEAST, value).alias("assign"),
        kept("access", ACCESS_LEAST, F.length).alias("access"), kept("hex", 0, F.length).alias("hex"))
    # a key id or a hexadecimal string that a string of this wider alphabet touches lies within it
    free = F.filter("tokens", lambda t: ~t["found"].rlike(HEX) & ~t["found"].rlike(ACCESS_ID) & ~F.exists(
        "assign", lambda a: (a["start"] < t["end"]) & (t["start"] < a["end"])))
    found = found.withColumn("tested", battery(free))
    p = lambda t: F.when((t["p_runs"] < odd) | (t["p_serial"] < odd), 1.0).otherwise(F.greatest(t["p_even"], F.lit(1e-40)))
    band = lambda t: sum((F.length(t["found"]) >= b).cast("int") for b in BANDS[1:])
    found = materialise(found.select(
        "doc_id", F.array_sort(F.concat("assign", "access", "hex")).alias("base"),
        F.transform("tested", lambda t: F.struct(
            t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end"),
            F.xxhash64(t["found"]).alias("name"), band(t).alias("band"),
            F.least(F.floor(-10 * F.log10(p(t))), F.lit(MOST_TENTHS)).cast("int").alias("tenths"))).alias("tested")), "secrets")
    limit = limits(found.select(F.inline("tested")), rate)
    least = F.create_map(*[F.lit(x) for kv in limit.items() for x in kv]) if limit else F.create_map().cast("map<int,int>")
    added = F.filter("tested", lambda t: t["tenths"] >= F.coalesce(F.element_at(least, t["band"]), F.lit(MOST_TENTHS + 1)))
    return found.select("doc_id", "base", F.transform(added, lambda t: F.struct(
        t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"))).alias("added"))


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
