"""Secret scan with multipart credential linking, DataFrame functions only.

Sure spans (base) are found by pattern: assignments of long values, access
identifiers, long hexadecimal runs. Weak candidates - a short assigned value, a
user name or client id, an endpoint - mean nothing alone; they are reported when
complementary parts of one credential stand within ``RADIUS`` code points, from
the end of one to the start of the other:

* a weak secret next to an identifier (sure or weak) or an endpoint;
* a weak identifier next to a secret (sure or weak);
* an endpoint next to both an identifier and a secret.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rota.llm import spans as sp
from rota.llm.frames import ID, KEY, fresh, keyed, meet, text_key
from rota.session import cut_lineage

RADIUS = 200
WEAK_LENGTH, SURE_LENGTH = 6, 12

# The base patterns; the value of an assignment is read again
# from the match with _VALUE.
_HEAD = r"(?:(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)"
_VALUE = _HEAD + r"([A-Za-z0-9+/_.=-]+)"
PATTERNS = {
    "assign": (_HEAD + r"[A-Za-z0-9+/_.=-]+", None),
    "access": (r"AKIA[A-Z0-9]{14,}", "AKIA"),
    "hex": (r"[0-9a-f]{16,}", None),
    "identifier": (r"(?i:user_?name|user_?id|login|client_?id|access_?key_?id|account)"
                   r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@-]{3,}", None),
    "endpoint": (r"(?i:[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]+)", "://"),
}
RANKS = {"assign": 0, "access": 1, "hex": 2, "secret": 3, "identifier": 4, "endpoint": 5}
BASE = ("assign", "access", "hex")
LABELS = {"assign": "[SECRET]", "access": "[ACCESS_KEY]", "hex": "[SECRET]",
          "secret": "[SECRET]", "identifier": "[IDENTIFIER]", "endpoint": "[ENDPOINT]"}


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``_id``, ``_key``, base, weak) per row: sure spans and weak candidates."""
    rows = keyed(docs, id_col, text_col, F.col(text_col).alias("_text"))
    rows = sp.find_spans(rows, F.col("_text"), PATTERNS, RANKS).drop("_text")
    size = lambda s: F.length(F.regexp_extract(s["value"], _VALUE, 1))
    sure = F.filter("assign", lambda s: size(s) >= SURE_LENGTH)
    weak = F.transform(
        F.filter("assign", lambda s: (size(s) >= WEAK_LENGTH) & (size(s) < SURE_LENGTH)),
        lambda s: F.struct(s["start"].alias("start"), F.lit(RANKS["secret"]).alias("rank"),
                           F.lit("secret").alias("kind"), s["end"].alias("end"),
                           s["value"].alias("value")))
    return rows.select(ID, KEY, F.concat(sure, "access", "hex").alias("base"),
                       F.concat(weak, "identifier", "endpoint").alias("weak"))


def _roles(kind):
    return (F.when(kind.isin("assign", "hex", "secret"), "secret")
            .when(kind.isin("access", "identifier"), "identifier").otherwise("endpoint"))


def linked(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(``_id``, ``_key``, linked): the weak candidates with their complement near.
    Rows that repeat one (id, text) count once."""
    own = found.where("size(weak) > 0").select(ID, KEY, F.explode("weak").alias("s"))
    own = own.select(ID, KEY, "s.start", "s.end", "s.rank", "s.kind").distinct()
    parts = found.where("size(weak) > 0").select(
        ID, KEY, F.explode(F.concat("base", "weak")).alias("s"))
    parts = parts.select(ID, KEY, F.col("s.start").alias("from"), F.col("s.end").alias("to"),
                         _roles(F.col("s.kind")).alias("role")).distinct()
    met = sp.near(own, parts, radius).groupBy(ID, KEY, "start", "end", "rank", "kind").agg(
        *[F.max((F.col("role") == r).cast("int")).alias(f"has_{r}")
          for r in ("secret", "identifier", "endpoint")])
    secret, ident, end = (F.col(f"has_{r}") == 1 for r in ("secret", "identifier", "endpoint"))
    whole = (F.when(F.col("kind") == "secret", ident | end)
             .when(F.col("kind") == "identifier", secret).otherwise(ident & secret))
    span = F.struct("start", "rank", "kind", "end", F.lit("").alias("value"))
    return met.where(whole).groupBy(ID, KEY).agg(F.collect_list(span).alias("linked"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 radius: int = RADIUS) -> DataFrame:
    """(``_id``, ``_key``, base, spans) of every row: sure spans, and these with the
    linked weak ones, both by start and then kind. Empty arrays for texts
    without any, NULL texts included. The text is scanned once; what follows
    moves only places."""
    found = cut_lineage(candidates(docs, id_col, text_col))
    more = linked(found, radius)
    none = F.array().cast(f"array<{sp.SPAN}>")
    return meet(found, more).select(
        ID, KEY, sp.by_start(F.col("base")).alias("base"),
        sp.by_start(F.concat("base", F.coalesce("linked", none))).alias("spans"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   chars_col: str | None = None) -> DataFrame:
    """``docs`` with every reported span replaced by a label; rows without any
    stay as they are. ``chars_col``: a column that holds the text's length and
    follows it."""
    key, spans = fresh(docs, "_text_key", "_spans")
    hits = (scan_secrets(docs, id_col, text_col).where("size(spans) > 0")
            .dropDuplicates([ID, KEY]).select(ID, KEY, F.col("spans").alias(spans)))
    met = meet(docs.withColumn(key, text_key(text_col)), hits, "left", id_col, key)
    out = met.withColumn(text_col, sp.redact(F.col(text_col), F.col(spans), LABELS, "[SECRET]"))
    if chars_col:
        out = out.withColumn(chars_col, F.when(F.col(spans).isNotNull(), F.length(text_col).cast(
            docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return out.drop(key, spans)
