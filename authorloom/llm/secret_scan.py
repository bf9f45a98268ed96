"""Secrets in texts, in DataFrame functions only: three fixed patterns and a randomness battery.

The base kinds are matched leftmost and without overlap. Other long tokens are candidates of
the kind ``random``: for each its encoding is inferred (hex, base32 or base64), and on the
values of its characters

* a chi-squared test of a uniform alphabet,
* a runs test above and below the middle of the alphabet,
* a test of serial correlation

must not reject randomness. Whether a token is *not* ordinary text is tested too, by the number
of equal pairs of characters, whose expectation under text grows with the square of the length.
These p-values, divided by the length's weight, go through the Benjamini-Hochberg procedure
over the candidates of a document, which bounds the share of false finds; longer tokens get
more of it.

Rules: a null or empty text has no spans. Spans are code points, end exclusive. Texts are read
whole. Random spans inside a base span are left out. Repeated rows get equal results; other
columns are kept by ``with_spans`` and ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
"""The matches of [0-9a-f]+ with 24 or more characters: a run is taken whole or not at all."""
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
SHARE = 0.05
"""Wanted bound on the share of false finds."""
LEAST_P = 0.01
"""The battery rejects randomness below this p-value, over its three tests."""
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _matches(text: Column, pattern: str) -> Column:
    """(match, start) of every match, from the texts between the matches; null if there are none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    walked = F.aggregate(
        F.arrays_zip(found.alias("match"), F.slice(between, 1, F.size(found)).alias("before")),
        F.struct(
            F.lit(0).alias("at"), F.array().cast("array<struct<match:string,start:int>>").alias("list")
        ),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["before"]) + F.length(m["match"])).alias("at"),
            F.concat(
                acc["list"],
                F.array(
                    F.struct(m["match"].alias("match"), (acc["at"] + F.length(m["before"])).alias("start"))
                ),
            ).alias("list"),
        ),
    )
    return F.when(F.rlike(text, F.lit(pattern)), walked["list"])


def _spans(matches: Column, kind: str, rank: int) -> Column:
    spans = F.transform(
        matches,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            (m["start"] + F.length(m["match"])).alias("end"),
        ),
    )
    return F.coalesce(spans.cast(SPAN), F.array().cast(SPAN))


def _tail(z: str) -> str:
    """SQL of a close logistic form of the normal distribution function at ``z``."""
    return f"(1 / (1 + exp(-(1.5976D * ({z}) + 0.070566D * pow({z}, 3)))))"


def _statistics(matches: Column) -> Column:
    """For each candidate (start, end, n, fits, unlike): the battery's p-value and that of text."""
    step1 = F.transform(
        matches,
        lambda m: F.struct(
            m["start"].alias("start"),
            (m["start"] + F.length(m["match"])).alias("end"),
            F.regexp_replace(m["match"], "=", "").alias("body"),
        ),
    )
    step2 = F.transform(
        F.filter(step1, lambda m: F.length(m["body"]) >= 16),
        lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.when(m["body"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.struct(F.lit(16).alias("m"), F.lower(m["body"]).alias("body"), F.lit("0123456789abcdef").alias("letters")))
            .when(m["body"].rlike("^[A-Z2-7]+$"), F.struct(F.lit(32).alias("m"), m["body"].alias("body"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567").alias("letters")))
            .otherwise(F.struct(F.lit(64).alias("m"), F.translate(m["body"], "-_", "+/").alias("body"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/").alias("letters")))
            .alias("code"),
        ),
    )
    return step2


def _battery(candidates: str) -> str:
    """SQL that turns encoded candidates into test results, one named step after the other."""
    values = (
        f"transform({candidates}, c -> named_struct('start', c.start, 'end', c.end, 'm', c.code.m, "
        "'v', transform(sequence(1, length(c.code.body)), "
        "i -> CAST(instr(c.code.letters, substring(c.code.body, i, 1)) - 1 AS DOUBLE))))"
    )
    sums = (
        f"transform({values}, c -> named_struct('start', c.start, 'end', c.end, 'm', c.m, 'v', c.v, "
        "'n', CAST(size(c.v) AS DOUBLE), "
        "'mean', aggregate(c.v, 0D, (a, x) -> a + x) / size(c.v), "
        "'squares', aggregate(transform(array_distinct(c.v), u -> size(filter(c.v, x -> x = u))), 0D, "
        "(a, k) -> a + CAST(k AS DOUBLE) * k), "
        "'high', CAST(size(filter(c.v, x -> x >= c.m / 2)) AS DOUBLE), "
        "'runs', 1D + size(filter(zip_with(slice(c.v, 1, size(c.v) - 1), slice(c.v, 2, size(c.v) - 1), "
        "(x, y) -> (x >= c.m / 2) != (y >= c.m / 2)), changed -> changed))))"
    )
    moments = (
        f"transform({sums}, c -> named_struct('start', c.start, 'end', c.end, 'n', c.n, "
        "'chi', (c.m * c.squares / c.n - c.n - (c.m - 1)) / sqrt(2 * (c.m - 1) * (c.n - 1) / c.n), "
        "'runs', c.runs, 'mu', 2 * c.high * (c.n - c.high) / c.n + 1, "
        "'spread', aggregate(c.v, 0D, (a, x) -> a + (x - c.mean) * (x - c.mean)), "
        "'lagged', aggregate(zip_with(slice(c.v, 1, size(c.v) - 1), slice(c.v, 2, size(c.v) - 1), "
        "(x, y) -> (x - c.mean) * (y - c.mean)), 0D, (a, x) -> a + x), "
        "'pairs', (c.squares - c.n) / 2, 'expected', c.n * (c.n - 1) / 2 * IF(c.m = 16, 0.10D, 0.055D), "
        "'kappa', IF(c.m = 16, 0.10D, 0.055D)))"
    )
    scores = (
        f"transform({moments}, c -> named_struct('start', c.start, 'end', c.end, 'n', c.n, 'z', array("
        "abs(c.chi), "
        "IF((c.mu - 1) * (c.mu - 2) > 0, abs(c.runs - c.mu) / sqrt((c.mu - 1) * (c.mu - 2) / (c.n - 1)), 9D), "
        "IF(c.spread > 0, abs(c.lagged / c.spread + 1 / c.n) * sqrt(c.n), 9D)), "
        "'text', (c.pairs - c.expected) / sqrt(c.expected + c.n * (c.n - 1) * (c.n - 2) * 0.35D * pow(c.kappa, 2))))"
    )
    return (
        f"transform({scores}, c -> named_struct('start', c.start, 'end', c.end, 'n', c.n, "
        f"'fits', least(1D, 3 * 2 * {_tail('-array_max(c.z)')}), 'unlike', {_tail('c.text')}))"
    )


def _accepted(results: str) -> str:
    """SQL of the candidates that pass the battery and the weighted Benjamini-Hochberg cut."""
    weighted = (
        f"transform({results}, c -> named_struct('start', c.start, 'end', c.end, 'fits', c.fits, "
        f"'q', c.unlike * (aggregate({results}, 0D, (a, x) -> a + x.n) / size({results})) / c.n))"
    )
    return weighted


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base_spans`` and ``all_spans``, ordered arrays of (start, rank, kind, end)."""
    text = F.coalesce("text", F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= 6
    found = docs.withColumns(
        {
            "_assign": _spans(F.filter(_matches(text, ASSIGN), value), "assign", 0),
            "_access": _spans(_matches(text, ACCESS), "access", 1),
            "_hex": _spans(_matches(text, HEX), "hex", 2),
            "_coded": _statistics(_matches(text, TOKEN)),
        }
    )
    found = found.withColumn("base_spans", F.array_sort(F.concat("_assign", "_access", "_hex")))
    found = found.withColumn(
        "_coded",
        F.filter(
            "_coded",
            lambda c: ~F.exists("base_spans", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])),
        ),
    )
    found = found.withColumn("_results", F.when(F.size("_coded") > 0, F.expr(_battery("_coded"))))
    found = found.withColumn("_results", F.expr(_accepted("_results")))
    found = found.withColumn("_q", F.array_sort(F.transform("_results", lambda c: c["q"])))
    found = found.withColumn(
        "_cut",
        F.expr(
            "array_max(transform(sequence(1, size(_q)), "
            f"k -> IF(_q[k - 1] <= {SHARE}D * k / size(_q), _q[k - 1], -1D)))"
        ),
    )
    random = F.transform(
        F.filter("_results", lambda c: (c["q"] <= F.col("_cut")) & (c["fits"] >= LEAST_P)),
        lambda c: F.struct(
            c["start"].alias("start"), F.lit(3).alias("rank"), F.lit("random").alias("kind"), c["end"].alias("end")
        ),
    )
    random = F.coalesce(F.when(F.col("_results").isNotNull(), random).cast(SPAN), F.array().cast(SPAN))
    return found.withColumn("all_spans", F.array_sort(F.concat("base_spans", random))).drop(
        "_assign", "_access", "_hex", "_coded", "_results", "_q", "_cut"
    )


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every document."""
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return with_spans(docs.select("doc_id", "text")).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed("base_spans"), 256).alias("base_sha256"),
        listed("all_spans").alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping ones by one."""
    columns = docs.columns
    text = F.col("text")
    walked = F.aggregate(
        "all_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                (s["start"] >= acc["at"]),
                F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    found = with_spans(docs).withColumn("_walked", F.when(F.size("all_spans") > 0, walked))
    clean = F.concat(F.col("_walked.out"), F.substr(text, F.col("_walked.at") + 1))
    return found.withColumn("text", F.coalesce(clean, text)).select(*columns)
