"""Secret scan: fixed patterns, and strings that two character Markov models tell from ordinary identifiers.

Only DataFrame expressions. The two first-order models (random strings, ordinary identifiers) are counted by Spark from
labelled samples that this module generates (``SAMPLES`` strings of each label, a documented bound): random strings of
eight alphabets; identifiers in several spellings, paths, numbers, dates, rules of one repeated sign and runs of syllables. Their
smoothed log-likelihood ratio per character pair is one constant table of 128 x 128 doubles. A word of at least ``MIN_LENGTH``
characters of the token alphabet that doesn't touch a pattern's span is added if the ratio says so and by nothing else: its sum over the
word's pairs, and its mean, must exceed what all but ``FALSE_RATE`` of the ordinary samples held out from counting reach, and
the sum must exceed the logarithm of ``ODDS``, the odds against a word being a secret.

Each pattern is looked for once in a text (twice where it is found, for places), behind a test for a string that any match has.

Defined cases: a null text is empty and has no span; texts of any length are scanned whole; repeated rows each give
their row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from temporis.llm.common import prefix_sums, spread

#: Fixed values of the contract. Runs are looked for from their first character only.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_MIN = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"

MIN_LENGTH, SAMPLES, FALSE_RATE, ODDS = 16, 12_000, 0.001, 1000.0
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
PARTS = (
    "get set user name file path read write index count total value order item list map key node tree table column row "
    "page view model data base cache queue event time date start end first last next open close create delete update "
    "find parse build load save send receive message content header body request response handler manager service "
    "client server session token state error result number string object array buffer stream socket thread process "
    "config option version window image color width height length offset position customer product invoice account "
    "the and ation ing tion ment ness able ible ous ive ent ant ers est ied ies pre con dis inter trans under over "
    "und der die ung keit lich heit schein ver ein nicht chen ach que les ette ique eau los cion ado ando idad mente aux eux ais oire"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """id, word, random: n random strings of eight alphabets and n ordinary words of twelve kinds."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    encoded = F.base64(F.unhex(digest))
    plain, letters = F.regexp_replace(encoded, "[+/=]", ""), F.regexp_replace(encoded, "[^A-Za-z]", "")
    alphabets = (encoded, plain, F.translate(encoded, "+/=", "-_"), F.lower(plain), F.upper(plain), letters, F.lower(letters), F.upper(digest))
    kind, size = F.col("id") % len(alphabets), (F.lit(MIN_LENGTH) + F.pmod(F.xxhash64("id"), F.lit(33))).cast("int")
    word = F.coalesce(*[F.when(kind == k, a) for k, a in enumerate(alphabets)])
    random = spark.range(n).select("id", F.substring(word, F.lit(1), size).alias("word"), F.lit(True).alias("random"))
    words = F.array(*map(F.lit, PARTS))
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(n)).cast("int")
    parts = [F.get(words, draw(k, len(PARTS))) for k in range(6)]
    number = F.format_string("%d", F.pmod(F.xxhash64(F.lit(9), F.col("id")), F.lit(10**12)))
    date = F.date_format(F.timestamp_seconds(F.lit(10**9) + draw(10, 10**9)), "yyyy-MM-dd-HH-mm-ss")
    kinds = (
        F.concat_ws("_", *parts[:4]), F.concat(parts[0], *[F.initcap(p) for p in parts[1:4]]), F.concat_ws("-", *parts[:4]), F.upper(F.concat_ws("_", *parts[:4])),
        F.concat_ws("/", parts[0], F.concat(*parts[1:3]), F.substring(number, 1, 4)), F.concat(*parts[:5]), F.initcap(F.concat(*parts[1:6])), F.upper(F.concat(*parts[:5])),
        F.concat(number, F.reverse(number)), date, F.repeat(F.get(F.array(*map(F.lit, "-_+/xo0#")), draw(11, 7)), draw(12, 60) + MIN_LENGTH),
        F.concat_ws("_", parts[0], F.concat(parts[1], F.substring(number, 1, 2)), parts[2], F.substring(number, 1, 5)),
    )
    kind = F.col("id") % len(kinds)
    ordinary = spark.range(n).select("id", F.coalesce(*[F.when(kind == k, w) for k, w in enumerate(kinds)]).alias("word"), F.lit(False).alias("random"))
    return random.unionByName(ordinary)


def held_out_sample() -> Column:
    """Samples that are not counted but set the thresholds."""
    return F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(4)) == 0


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each ASCII pair, row-major: log P(next | char, random) - log P(next | char, ordinary)."""
    from math import log

    chars = F.split("word", "")
    pairs = samples.select(
        "random",
        F.explode(F.arrays_zip(F.slice(chars, 1, F.length("word") - 1).alias("a"), F.slice(chars, 2, F.length("word") - 1).alias("b"))).alias("p"),
    )
    counts = pairs.groupBy("random", F.ascii("p.a").alias("a"), F.ascii("p.b").alias("b")).count()
    seen: dict[bool, dict[tuple[int, int], int]] = {True: {}, False: {}}
    for r in counts.where("a < 128 and b < 128").collect():  # at most 2 * 128 * 128 rows
        seen[r["random"]][r["a"], r["b"]] = r["count"]
    rows = {k: [sum(v.get((a, b), 0) for b in range(128)) for a in range(128)] for k, v in seen.items()}

    def p(label: bool, a: int, b: int) -> float:
        return (seen[label].get((a, b), 0) + 0.5) / (rows[label][a] + 0.5 * 66)

    return [round(log(p(True, a, b) / p(False, a, b)), 4) for a in range(128) for b in range(128)]


def constant(table: list[float]) -> Column:
    """A trained table as one constant array."""
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")


@lru_cache(maxsize=1)
def _trained(app: str) -> tuple[tuple[float, ...], float, float]:
    samples = labelled_samples(SparkSession.getActiveSession())
    table = train(samples.where(~held_out_sample()))
    ratio = mean_ratio(F.col("word"), constant(table))
    high = lambda c: F.percentile(c, F.lit(1 - FALSE_RATE))
    r = samples.where(held_out_sample() & ~F.col("random")).select(ratio.alias("r")).agg(high(F.col("r.total")).alias("total"), high(F.col("r.mean")).alias("mean")).first()
    from math import log

    return tuple(table), max(r["total"], log(ODDS)), max(r["mean"], 0.0)


def trained(spark: SparkSession) -> tuple[list[float], float, float]:
    """The table of ratios, and the sum and the mean that a secret must exceed."""
    table, total, mean = _trained(spark.sparkContext.applicationId)
    return list(table), total, mean


_SPANS = "array<struct<start:bigint,end:bigint,kind:string,word:string>>"


def found_in(text: Column, pattern: str, may: Column | None = None) -> Column:
    """A pattern's leftmost non-overlapping matches, looked for only where may holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if may is None else F.when(may, found).otherwise(F.expr("cast(array() as array<string>)"))


def spans_of(text: Column, pattern: str, kind: str, found: Column) -> Column:
    """array of (start, end, kind, word) of the matches found, in code points."""
    gaps = F.split(text, pattern, -1)
    lens = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
    spans = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(prefix_sums(lens), F.lit(1), F.size(found)).alias("e")),
        lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), F.lit(kind).alias("kind"), x["m"].alias("word")),
    )
    return F.when(F.size(found) > 0, spans).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def mean_ratio(word: Column, table: Column) -> Column:
    """(total, mean) log-likelihood ratio of a word's character pairs."""
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c))
    n = F.length(word) - 1
    total = F.aggregate(
        F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.get(table, a * 128 + b)),
        F.lit(0.0),
        lambda s, x: s + F.coalesce(x, F.lit(0.0)),
    )
    return F.struct(total.alias("total"), (total / n).alias("mean"))


def scan(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with base and spans: the fixed patterns' and all spans, arrays of (start, end, kind) by start, then kind as listed.

    Columns of docs that have these names are replaced.
    """
    table, least_total, least_mean = trained(docs.sparkSession)
    table = constant(table)
    text = F.coalesce(F.col(column), F.lit(""))
    low = F.lower(text)
    named = (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & F.greatest(*[F.contains(low, F.lit(n)) for n in ASSIGN_NAMES])
    out = docs.withColumns({
        "_assign": found_in(text, ASSIGN, named), "_access": found_in(text, ACCESS, F.contains(text, F.lit("AKIA"))), "_hex": found_in(text, HEX), "_token": found_in(text, TOKEN),
    })

    def order(s: Column) -> Column:
        rank = F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
        return F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))

    long = lambda s: F.length(F.regexp_extract(s["word"], ASSIGN, 2)) >= ASSIGN_MIN
    base = F.concat(
        F.filter(spans_of(text, ASSIGN, "assign", F.col("_assign")), long),
        spans_of(text, ACCESS, "access", F.col("_access")),
        spans_of(text, HEX, "hex", F.col("_hex")),
    )
    out = out.withColumn("_base", F.array_sort(F.transform(base, order)))

    def likely(word: Column) -> Column:
        ratio = mean_ratio(word, table)
        return (ratio["total"] > least_total) & (ratio["mean"] > least_mean)

    def random(s: Column) -> Column:
        apart = ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return likely(s["word"]) & apart

    words = F.when(F.exists("_token", likely), spans_of(text, TOKEN, "markov", F.col("_token"))).otherwise(F.expr(f"cast(array() as {_SPANS})"))
    out = out.withColumn("_added", F.transform(F.filter(words, random), order))
    fields = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    out = out.withColumn("spans", F.transform(F.array_sort(F.concat("_base", "_added")), fields))
    return out.withColumn("base", F.transform("_base", fields)).drop("_base", "_added", "_assign", "_access", "_hex", "_token")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with each span of a secret (overlapping ones joined) replaced by mask; other columns as they were."""
    scanned = scan(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    pieces = F.aggregate(
        "spans",
        start,
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(
                x["end"].alias("at"),
                F.concat(s["out"], F.array(F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask))).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
    )
    clean = F.concat(F.array_join(pieces["out"], ""), F.substring(F.col("text"), (pieces["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    return scanned.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
