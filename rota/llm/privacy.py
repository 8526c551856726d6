"""Personal data: pattern spans, and terms that give a protected entity away.

Protected entities are the values found by pattern (mail and network addresses,
card and telephone numbers), and coarser ones behind them: the mail host, the
network, the card's issuer, the telephone exchange, and the kind as such. Most
values stand in a document or two, where nothing can be learnt about them; the
coarser ones carry the evidence.

What a term t tells about an entity e is estimated over the whole corpus, by
documents (distinct pairs of id and text, so repeated rows change nothing). With
IC(e) = -log2 p(e) the information of the entity and PMI(e, t) = log2 p(e, t) / (p(e) p(t)),
the disclosure PMI / IC is 1 when t never stands in a document without e, and
0 when they are independent. Beside it, the estimate needs evidence:

* the lower bound (Wilson, ``CONFIDENCE`` deviations) of p(e | t) reaches ``EVIDENCE``; it
  rises with the counts, and three documents of three are the least that do;
* such a coincidence is unlikely anywhere in the corpus: by Chernoff's bound its chance
  is below 2^-(n KL(p(e | t), p(e))), which times the number of pairs compared
  is at most ``CHANCE``.

Terms that reach ``REMOVE`` are removed wherever they stand in a document with
e, those that reach ``GENERALISE`` are replaced by a general word.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rota.llm import spans as sp
from rota.llm.frames import ID, KEY, fresh, keyed, meet, text_key
from rota.session import cut_lineage

GENERALISE, REMOVE = 0.8, 0.9
EVIDENCE, CONFIDENCE, CHANCE = 0.5, 1.645, 0.05
SHORTEST = 2          # letters and digits of a term
FEW_REPEATS = 100_000

# The base patterns. A search starts where the last match ended
# or at the start of a run of its first characters, which finds the same
# leftmost matches without trying every place of a long run.
_RUN = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": (rf"(?:\G|(?<![{_RUN}]))[{_RUN}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
RANKS = {"email": 0, "ip": 1, "card": 2, "phone": 3, "remove": 4, "generalise": 5}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]",
          "remove": "", "generalise": "[TERM]"}
# Terms are runs of letters, digits and non-ASCII characters.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_DOC = "_doc"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, 9 taken off above 9; the sum
    ends in 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _kept(name: str, spans: Column) -> Column:
    value = lambda s: s["value"]
    size = lambda s: F.length(_digits(value(s)))
    if name == "ip":
        return F.filter(spans, lambda s: F.forall(F.split(value(s), r"\."),
                                                  lambda p: p.cast("double") <= 255))
    if name == "card":
        fits = F.filter(spans, lambda s: (size(s) >= 13) & (size(s) <= 19))
        return F.filter(fits, lambda s: _luhn(_digits(value(s))))
    if name == "phone":
        return F.filter(spans, lambda s: (size(s) >= 9) & (size(s) <= 15))
    return spans


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``_id``, ``_key``, base, _text) per row: base spans, and the text where there are any."""
    rows = keyed(docs, id_col, text_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = sp.find_spans(rows, F.col("_text"), PATTERNS, RANKS)
    rows = rows.withColumn("base", F.concat(*[_kept(n, F.col(n)) for n in PATTERNS]))
    return rows.select(ID, KEY, "base", F.when(F.size("base") > 0, F.col("_text")).alias("_text"))


def _terms(text: Column, shortest: int) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), _NO_TERM)), lambda t: F.length(t) >= shortest)


def _entities(span: Column) -> Column:
    """An entity and the coarser ones behind it."""
    kind, value = span["kind"], span["value"]
    digits = _digits(value)
    group = (F.when(kind == "email", F.lower(F.substring_index(value, "@", -1)))
             .when(kind == "ip", F.substring_index(value, ".", 3))
             .when(kind == "card", F.substring(digits, 1, 6))
             .otherwise(F.substr(digits, F.lit(1), F.length(digits) - 4)))
    return F.array(F.concat_ws(":", F.lit("value"), kind, value), F.concat_ws(":", F.lit("group"), kind, group),
                   F.concat_ws(":", F.lit("kind"), kind))


def entity_classes(texts: DataFrame, least: int) -> DataFrame:
    """(``_id``, ``_key``, class, n_entity): entities of ``least`` documents or more, by
    document. Entities of the very same documents are one class, so a list of
    addresses that is always given whole costs one row a document."""
    own = (texts.select(ID, KEY, F.explode("base").alias("s"))
           .select(ID, KEY, F.explode(_entities(F.col("s"))).alias("entity")).distinct()
           .withColumn(_DOC, F.xxhash64(ID, KEY)))
    sizes = (own.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_entity"), F.bit_xor(_DOC).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), _DOC)).alias("b"))
        .where(F.col("n_entity") >= least)
        .select("entity", "n_entity", F.struct("n_entity", "a", "b").alias("class")))
    return own.join(sizes, "entity").select(ID, KEY, "class", "n_entity").distinct()


def repeated(found: DataFrame) -> DataFrame | None:
    """(``_id``, ``_key``) of documents in several rows, None if there are none; up to
    ``FEW_REPEATS`` of them are marked for a broadcast."""
    again = cut_lineage(found.groupBy(ID, KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(ID, KEY))
    n = again.count()
    return None if not n else F.broadcast(again) if n <= FEW_REPEATS else again


def telling_terms(docs: DataFrame, texts: DataFrame, terms: DataFrame, repeats: DataFrame | None, id_col: str,
                  text_col: str, least: int, evidence: float, shortest: int) -> DataFrame:
    """(term, n_term): terms of the texts with entities that can reach the evidence,
    with the documents of the corpus that hold them outside pattern spans."""
    wanted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_near")).where(F.col("n_near") >= least)
    said = F.explode(_terms(F.coalesce(F.col(text_col), F.lit("")), shortest)).alias("term")
    held = docs.select(said).groupBy("term").agg(F.count(F.lit(1)).alias("n_held"))
    if repeats is not None:
        # Rows that say the same again, taken off once each.
        (key,) = fresh(docs, "_text_key")
        rows = meet(docs.withColumn(key, text_key(text_col)), repeats, "left_semi", id_col, key)
        again = (rows.select(F.xxhash64(F.col(id_col), F.col(key)).alias(_DOC), said)
                 .groupBy("term", _DOC).agg((F.count(F.lit(1)) - 1).alias("n"))
                 .groupBy("term").agg(F.sum("n").alias("n_again")))
        held = held.join(again, "term", "left").select(
            "term", (F.col("n_held") - F.coalesce("n_again", F.lit(0))).alias("n_held"))
    # Terms of a whole text that are none outside its spans, and the other way round
    # (a span may start or end inside a word).
    whole, rest = _terms(F.col("_text"), shortest), _terms(F.col("_blank"), shortest)
    change = (texts.select(F.explode(F.concat(
        F.transform(F.array_except(whole, rest), lambda t: F.struct(t.alias("term"), F.lit(-1).alias("by"))),
        F.transform(F.array_except(rest, whole), lambda t: F.struct(t.alias("term"), F.lit(1).alias("by"))))).alias("c"))
        .groupBy(F.col("c.term").alias("term")).agg(F.sum("c.by").alias("n_change")))
    n_term = F.coalesce("n_held", F.lit(0)) + F.coalesce("n_change", F.lit(0))
    return (wanted.join(held, "term", "left").join(change, "term", "left").select("term", "n_near", n_term.alias("n_term"))
            .where(F.col("n_near") >= evidence * F.col("n_term")).drop("n_near"))


def disclosures(joint: DataFrame, total: int, tests: int, evidence: float = EVIDENCE,
                confidence: float = CONFIDENCE, chance: float = CHANCE) -> DataFrame:
    """(class, term, disclosure) of the pairs (class, term, n_both, n_term, n_entity) with
    evidence, out of ``total`` documents and ``tests`` pairs compared."""
    n, z = F.col("n_term"), confidence
    p = F.least(F.col("n_both") / n, F.lit(1.0))
    prior = F.col("n_entity") / F.lit(float(max(total, 1)))
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    known = lambda a, b: F.when(a > 0, a * F.log2(a / b)).otherwise(0.0)
    bits = n * (known(p, prior) + known(1 - p, 1 - prior))
    information = -F.log2(prior)
    sure = (prior < 1) & (p > prior) & (low >= evidence - 1e-9) & (bits >= math.log2(max(tests, 1) / chance) - 1e-9)
    return joint.where(sure).select("class", "term", (1 + F.log2(p) / information).alias("disclosure"))


def scan_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 generalise: float = GENERALISE, remove: float = REMOVE, evidence: float = EVIDENCE,
                 confidence: float = CONFIDENCE, chance: float = CHANCE, shortest: int = SHORTEST) -> DataFrame:
    """(``_id``, ``_key``, base, spans) of every row: pattern spans by kind and
    start, and these with every occurrence of a disclosing term in the documents
    that hold its entity, outside the pattern spans. Empty arrays where nothing is
    found, NULL texts included. Terms of fewer than ``shortest`` characters are not
    looked at. A pair of entity and term is met only where the entity's documents are enough for the
    term's, so neither rare entities nor common words are paired."""
    least = max(math.ceil(confidence ** 2 * evidence / (1 - evidence) - 1e-9), 1)
    found = cut_lineage(candidates(docs, id_col, text_col))
    total = found.select(F.xxhash64(ID, KEY)).distinct().count()
    texts = found.where("size(base) > 0").dropDuplicates([ID, KEY])
    texts = cut_lineage(texts.select(ID, KEY, "base", "_text", sp.blank(F.col("_text"), F.col("base")).alias("_blank")))
    terms = texts.select(ID, KEY, F.explode(_terms(F.col("_blank"), shortest)).alias("term"))
    telling = cut_lineage(telling_terms(docs, texts, terms, repeated(found), id_col, text_col, least, evidence, shortest))
    terms = terms.join(telling, "term")
    classes = cut_lineage(entity_classes(texts, least))
    met = meet(terms, classes, "inner", extra=lambda r: F.col("n_entity") >= evidence * F.col("n_term"))
    joint = cut_lineage(met.groupBy("class", "term").agg(
        F.count(F.lit(1)).alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity")))
    told = (disclosures(joint, total, joint.count(), evidence, confidence, chance)
            .where(F.col("disclosure") >= generalise - 1e-9))

    named = terms.join(told.withColumnRenamed("class", "_class"), "term")
    named = meet(named, classes, "inner", extra=lambda r: F.col("_class") == F.col("class"))
    kind = F.when(F.max("disclosure") >= remove - 1e-9, "remove").otherwise("generalise")
    named = named.groupBy(ID, KEY, "term").agg(kind.alias("kind"))
    named = named.groupBy(ID, KEY).agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds"))
    hits = sp.find_spans(meet(texts.select(ID, KEY, "_blank"), named, "inner"), F.col("_blank"),
                         {"w": (_TERM, None)}, {"w": 0})
    of = lambda s: F.try_element_at("kinds", F.lower(s["value"]))
    more = hits.select(ID, KEY, F.transform(F.filter("w", lambda s: of(s).isNotNull()), lambda s: F.struct(
        s["start"].alias("start"), F.when(of(s) == "remove", RANKS["remove"]).otherwise(RANKS["generalise"]).alias("rank"),
        of(s).alias("kind"), s["end"].alias("end"), F.lit("").alias("value"))).alias("more"))
    none = F.array().cast(f"array<{sp.SPAN}>")
    return meet(found.select(ID, KEY, "base"), more).select(
        ID, KEY, sp.by_rank(F.col("base")).alias("base"),
        sp.by_rank(F.concat("base", F.coalesce("more", none))).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by labels, disclosing terms removed or
    replaced by ``[TERM]``; rows without any stay as they are."""
    key, spans = fresh(docs, "_text_key", "_spans")
    hits = (scan_private(docs, id_col, text_col).where("size(spans) > 0")
            .dropDuplicates([ID, KEY]).select(ID, KEY, F.col("spans").alias(spans)))
    met = meet(docs.withColumn(key, text_key(text_col)), hits, "left", id_col, key)
    return met.withColumn(text_col, sp.redact(
        F.col(text_col), F.col(spans), LABELS, "[TERM]")).drop(key, spans)
