"""Secret scans: base patterns, and a battery of randomness tests under false-discovery control.

All in DataFrame functions. Candidates of the battery are long runs of encoding characters. For
each distinct candidate an encoding is inferred; chi-squared uniformity of its symbols, the number
of runs above and below the middle of the alphabet, and the serial correlation of neighbours give
three p-values under "symbols are drawn at random", which Fisher's rule combines. Text fails these
tests, a key does not. In each stratum of encoding and length, the threshold on the combined
p-value is the lowest at which the estimated share of text among what is reported, with the error
of that estimate added, stays below a limit: random strings have uniform p-values, so those above a half tell how many there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyquilt.llm.common import materialize

#: Fixed patterns of the base kinds. Kinds are listed in the order that breaks ties.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs of the two alphabets that encodings share; padding only at the end, so that a name before "=" and a path before a key are cut off.
CANDIDATES = (r"[A-Za-z0-9+/]{20,}={0,6}", r"[A-Za-z0-9_-]{20,}={0,6}")
#: Encodings as (name, pattern of the whole run, symbols, where a kind of symbol ends); the first that fits is inferred.
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789", (10,)),
    ("hex", "^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef", (10, 16)),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (26, 32)),
    ("base36", "^[0-9a-z]+$|^[0-9A-Z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", (10, 36)),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (26, 52, 64)),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", (26, 52, 64)),
)
#: Runs with less information than this many bits, were they random, are not tested.
MIN_BITS = 80
BINS = 64
FALSE_DISCOVERY = 0.05
LEAST_P = 0.01
#: From this p-value on, what is seen counts as random.
RANDOM_P = 0.5


#: Matches of a text are numbered in blocks of this many, so that long lists cost little more than short ones.
BLOCK = 64


def let(value: Column, then) -> Column:  # noqa: ANN001
    """``then`` applied to a value that is evaluated once."""
    return F.get(F.transform(F.array(value), then), 0)


def running(sizes: Column) -> Column:
    """``start, end`` of matches from structs ``gap, n``, in order."""
    def within(block: Column, at: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["n"]).alias("at"),
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end")))).alias("out"),
            ),
            lambda a: a["out"],
        )

    def joined_blocks(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["n"]))
        starts = F.aggregate(lengths, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), within))

    last = F.greatest(F.size(sizes) - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), lambda k: F.slice(sizes, k * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(sizes) <= BLOCK, within(sizes, F.lit(0))).otherwise(let(blocks, joined_blocks))


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as structs ``start, end, value`` in code points; value is the group's, or the match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n")))
    places = let(sizes, running)
    found = F.zip_with(places, value, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def joined(ordered: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def two_sided(z: Column) -> Column:
    """Two-sided p-value of a standard normal z, by a logistic approximation of its distribution."""
    a = F.least(F.abs(z), F.lit(8.0))
    return F.greatest(2 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a)), F.lit(1e-12))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def chi_squared(terms: Column, df: Column) -> Column:
    """Upper tail of the sum of terms under df degrees of freedom, by Wilson and Hilferty's normal form."""
    def z(chi2: Column) -> Column:
        return (F.pow(chi2 / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))

    return let(let(total(terms), z), lambda z: F.when(z <= 0, 1 - two_sided(z) / 2).otherwise(two_sided(z) / 2))


def squared_gap(seen: Column, expected: Column) -> Column:
    return let(F.struct(expected.alias("e"), seen.alias("s")), lambda t: (t["s"] - t["e"]) * (t["s"] - t["e"]) / t["e"])


def uniformity(v: Column, n: Column, size: Column, kinds: Column) -> Column:
    """p-value of two chi-squared tests: over classes of neighbouring symbols, and over kinds (letters, digits).

    As many classes as keep five expected symbols in each, 4 to 16; they differ in size where the
    number of symbols is not a multiple. Of two tests the smaller p-value counts, made uniform again.
    """
    def first(k: Column, classes: Column) -> Column:
        return F.ceil(k * size / classes)

    def by_class(classes: Column) -> Column:
        def term(k: Column) -> Column:
            return squared_gap(F.size(F.filter(v, lambda x: F.floor(x * classes / size) == k)), n * (first(k + 1, classes) - first(k, classes)) / size)

        return chi_squared(F.transform(F.sequence(F.lit(0), classes - 1), term), (classes - 1).cast("double"))

    def kind_term(end: Column, k: Column) -> Column:
        begin = F.coalesce(F.get(kinds, k - 1), F.lit(0))
        return squared_gap(F.size(F.filter(v, lambda x: (x >= begin) & (x < end))), n * (end - begin) / size)

    one = let(F.least(F.lit(16), F.greatest(F.lit(4), F.floor(n / 5))).cast("int"), by_class)
    both = let(F.least(one, chi_squared(F.transform(kinds, kind_term), (F.size(kinds) - 1).cast("double"))), lambda p: 1 - (1 - p) * (1 - p))
    return F.greatest(F.when(F.size(kinds) > 1, both).otherwise(one), F.lit(1e-12))


def runs(v: Column, n: Column, size: Column) -> Column:
    """p-value of Wald and Wolfowitz's number of runs below and above the middle of the alphabet."""
    def p(t: Column) -> Column:
        mean = 2 * t["high"] * (n - t["high"]) / n + 1
        z = let(mean, lambda m: (t["runs"] - m) / F.sqrt((m - 1) * (m - 2) / (n - 1)))
        return F.when((t["high"] < 2) | (t["high"] > n - 2), F.lit(1e-12)).otherwise(two_sided(z))

    sides = F.transform(v, lambda x: (x * 2 >= size).cast("int"))
    changes = lambda s: F.size(F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) != F.get(s, i - 1)))
    return let(let(sides, lambda s: F.struct(F.aggregate(s, F.lit(0), lambda a, x: a + x).cast("double").alias("high"), (changes(s) + 1).alias("runs"))), p)


def serial(v: Column, n: Column) -> Column:
    """p-value of the correlation of neighbouring symbols."""
    def p(d: Column) -> Column:
        spread = total(F.transform(d, lambda x: x * x))
        lagged = total(F.transform(d, lambda x, i: x * F.coalesce(F.get(d, i + 1), F.lit(0.0))))
        r = F.try_divide(lagged, spread)
        return F.coalesce(let((r + 1 / n) * F.sqrt(n), two_sided), F.lit(1e-12))

    return let(let(total(v) / n, lambda m: F.transform(v, lambda x: x - m)), p)


def combined(symbols: Column, alphabet: Column, kinds: Column) -> Column:
    """Fisher's combination of the three p-values."""
    def all_three(v: Column) -> Column:
        n, size = F.size(v).cast("double"), F.length(alphabet)
        half = -(F.log(uniformity(v, n, size, kinds)) + F.log(runs(v, n, size)) + F.log(serial(v, n)))
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return let(F.transform(F.split(symbols, ""), lambda c: F.call_function("locate", c, alphabet) - 1), all_three)


def battery(tokens: DataFrame) -> DataFrame:
    """``token`` with its ``encoding, length, p``; rows below ``MIN_BITS`` or of no encoding go."""
    def choose(values: list) -> Column:
        out = F.lit(None)
        for (_, pattern, *_), v in reversed(list(zip(ENCODINGS, values, strict=True))):
            out = F.when(F.col("token").rlike(pattern), v).otherwise(out)
        return out

    t = tokens.select("token", choose([F.lit(e[0]) for e in ENCODINGS]).alias("encoding"), choose([F.lit(e[2]) for e in ENCODINGS]).alias("alphabet"), choose([F.array(*map(F.lit, e[3])) for e in ENCODINGS]).alias("kinds")).where(F.col("encoding").isNotNull())
    same_case = F.when(F.col("encoding").isin("hex", "base36"), F.lower("token")).otherwise(F.col("token"))
    symbols = F.regexp_replace(same_case, "=+$", "")
    length = F.length(symbols)
    return t.where(length * F.log2(F.length("alphabet")) >= MIN_BITS).select("token", "encoding", length.alias("length"), combined(symbols, F.col("alphabet"), F.col("kinds")).alias("p"))


def stratum() -> Column:
    """Encoding and length class, lengths by powers of two."""
    return F.concat_ws("/", "encoding", F.floor(F.log2("length")).cast("string"))


def thresholds(tested: DataFrame, limit: float) -> dict[str, float]:
    """Lowest p-value to report, by stratum. The driver sees a count for each stratum and bin only."""
    binned = tested.groupBy(stratum().alias("s"), F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("b")).count().collect()
    by: dict[str, list[int]] = {}
    for s, b, n in binned:
        by.setdefault(s, [0] * BINS)[b] += n
    out = {}
    for s, counts in by.items():
        edge = int(BINS * RANDOM_P)
        out[s] = RANDOM_P  # there the estimate is 0
        for b in range(edge - 1, -1, -1):
            reported, below, share = sum(counts[b:]), sum(counts[b:edge]), 1 - b / edge
            false = below - share * sum(counts[edge:])
            error = (below + share * share * sum(counts[edge:])) ** 0.5  # of that estimate: both counts are random
            if false + error > limit * reported:
                break
            out[s] = max(b / BINS, LEAST_P)
    return out


def find_secrets(docs: DataFrame, limit: float = FALSE_DISCOVERY) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are whole matches ``kind:start:end`` in code points, ordered by start and then kind
    (assign, access, hex, random), joined by commas; ``base_sha256`` is of the first three kinds.
    Random spans inside a base hex or access span, or inside a longer random one, are not repeated. Statistics are over the distinct candidates of
    all documents. Null and empty texts have no spans; repeated rows are reported each; an empty
    table gives an empty result; only doc_id and text are used.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 8)
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), spans(assign, 0).alias("assign"), spans(matches(text, ACCESS), 1).alias("access"), spans(matches(text, HEX), 2).alias("hex"), F.array_distinct(F.concat(*[matches(text, c) for c in CANDIDATES])).alias("candidates"))
    rows = materialize(rows, "spans")  # the texts are scanned once
    base = F.array_sort(F.concat("assign", "access", "hex"))
    candidates = rows.where(F.size("candidates") > 0).select("text_key", F.explode("candidates").alias("c")).select("text_key", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.value").alias("token"))
    tested = materialize(battery(candidates.select("token").distinct()), "tested")
    kept = thresholds(tested, limit)
    least = F.element_at(F.create_map(*[F.lit(x) for kv in kept.items() for x in kv]), stratum()) if kept else F.lit(2.0)
    reported = tested.where(F.col("p") >= F.coalesce(least, F.lit(2.0))).select("token")
    # equal texts have equal candidates, so copies are joined once
    found = candidates.distinct().join(reported, "token").groupBy("text_key").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("random"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rows = rows.join(found, "text_key", "left").withColumn("base", base)
    def inside(others: Column) -> Callable[[Column], Column]:
        return lambda r: F.exists(others, lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"]) & ((b["start"] < r["start"]) | (r["end"] < b["end"]) | (b["kind"] != r["kind"])))

    fresh = F.filter(F.coalesce("random", none), lambda r: ~inside(F.concat("access", "hex", F.coalesce("random", none)))(r))
    return rows.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", fresh))).alias("spans"),
    )
