"""Secret scan with built-in functions only: three patterns, and sliding-window entropy over other strings.

A match is placed by the lengths of the pieces between the matches, so offsets count code points. Candidate
strings of the entropy method are maximal runs of 20 or more base64 or name characters with a letter and a
digit. Counts per character are carried along the string: a step adds the entering character and takes the
leaving one out, and the largest Shannon entropy of any window decides. Each character class (hexadecimal or
base64) has its own limit. Candidates on the allow list, or that overlap a pattern match, are left out.

Cases: a null or empty text has no spans; repeated rows are scanned alike; every column of the input stays
as it is, and added columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits per character that a window must reach, by the character class of the string.
LIMITS = {"hex": 3.2, "base64": 3.9}
#: Strings of these shapes are no secrets: identifiers, paths of words, placeholders, runs of the alphabet.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    r"(?i)example|sample|placeholder|dummy|xxxx",
    r"^/?([A-Za-z]+[/_=-])+[A-Za-z]*[0-9]{0,4}$",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
)
MARK = "[SECRET]"


def placed(text: Column, pattern: str, kind: str, keep: Column | None = None) -> Column:
    """Array of (start, kind number, end, string) of the leftmost non-overlapping matches."""
    number = KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = keep if keep is not None else found
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.arrays_zip(pieces.alias("gap"), found.alias("string"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,string:string,value:string>>")
    spans = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.length(x["string"])).alias("at"),
            F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(x["gap"])).alias("start"), F.lit(number).alias("kind"),
                (a["at"] + F.length(x["gap"]) + F.length(x["string"])).alias("end"), x["string"].alias("string"), x["value"].alias("value"),
            ))).alias("spans"),
        ),
    )["spans"]
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def plogp(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def largest_entropy(string: Column, window: int = WINDOW) -> Column:
    """Largest entropy in bits of any window of the string, by counts carried from window to window."""
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(string, i, F.lit(1)))
    moved = lambda counts, at, by: F.transform(counts, lambda c, k: F.when(k + 1 == at, c + by).otherwise(c))
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"),
    )

    def step(a: Column, i: Column) -> Column:
        into, gone = place(i), place(i - window)
        was = F.element_at(a["counts"], into)
        grown = F.struct(moved(a["counts"], into, 1).alias("counts"), (a["sum"] + plogp(was + 1) - plogp(was)).alias("sum"))
        left = F.element_at(grown["counts"], gone)
        shrunk = F.struct(moved(grown["counts"], gone, -1).alias("counts"), (grown["sum"] + plogp(left - 1) - plogp(left)).alias("sum"))
        now = F.when(i > window, shrunk).otherwise(grown)
        entropy = F.when(i >= window, F.log2(F.lit(float(window))) - now["sum"] / window).otherwise(F.lit(0.0))
        return F.struct(now["counts"].alias("counts"), now["sum"].alias("sum"), F.greatest(a["best"], entropy).alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.length(string)), zero, step)["best"]


def secret_spans(text: Column) -> tuple[Column, Column]:
    """(pattern spans, entropy spans that may overlap them), each an array of structs sorted by start and kind."""
    groups = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(placed(text, ASSIGN, "assign", groups), lambda s: F.length(s["value"]) >= 6)
    access = F.filter(placed(text, ACCESS, "access"), lambda s: F.length(s["string"]) >= 20)
    base = F.array_sort(F.concat(assign, access, placed(text, HEX, "hex")))
    allowed = lambda s: F.lit(False) if not ALLOWED else s.rlike("|".join(f"(?:{p})" for p in ALLOWED))
    limit = lambda s: F.when(s.rlike("^[0-9a-fA-F]+$"), F.lit(LIMITS["hex"])).otherwise(F.lit(LIMITS["base64"]))
    suspects = F.filter(
        placed(text, CANDIDATE, "entropy"),
        lambda s: s["string"].rlike("[0-9]") & s["string"].rlike("[A-Za-z]") & ~allowed(s["string"]),
    )
    return base, F.filter(suspects, lambda s: largest_entropy(s["string"]) >= limit(s["string"]))


def scan(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with base_spans and spans: arrays of (start, kind, end), code points, end exclusive."""
    text = F.coalesce(column, F.lit(""))
    base, suspects = secret_spans(text)
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    out = docs.withColumn("base_spans", base).withColumn("spans", suspects)
    apart = F.filter("spans", lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = out.withColumn("spans", F.array_sort(F.concat("base_spans", apart)))
    return out.withColumn("base_spans", F.transform("base_spans", bare)).withColumn("spans", F.transform("spans", bare))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by a mark."""
    done = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(MARK)))
            .otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
