"""DuckDB SQL for the operators of this subpackage that SQL can express."""

from __future__ import annotations

from rota.llm import chat
from rota.llm.collocations import LONGEST, NO_LANGUAGE, SUBSUMED, SUPPORT, TOP
from rota.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, _words, window
from rota.llm.queries import DIMS, NEAREST, QUERY_STEP
from rota.llm.substrings import WIDTH

SUBSTRINGS_SQL = rf"""
WITH split AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
starts AS MATERIALIZED (
    SELECT doc_id, p, array_to_string(words[p:p + {WIDTH - 1}], ' ') AS shown
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WIDTH - 2})) AS p FROM split)),
earliest AS (SELECT shown, min(doc_id) AS low FROM starts GROUP BY shown),
covered AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + {WIDTH})) AS p
    FROM starts JOIN earliest USING (shown) WHERE low < doc_id),
gone AS (SELECT doc_id, list(p) AS places FROM covered GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
       sha256(array_to_string(
           CASE WHEN places IS NULL THEN words
                ELSE [w FOR w, i IN words IF NOT list_contains(places, i)] END, ' ')) AS kept_sha256
FROM split LEFT JOIN gone USING (doc_id)
"""

HAMMING_SQL = f"""
WITH codes AS (
    SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS bits FROM embeddings),
pairs AS (
    SELECT q.vec_id AS query_id, b.vec_id,
           list_sum(list_transform(list_zip(q.bits, b.bits), lambda z: (z[1] <> z[2])::INT))::INT AS distance
    FROM codes q, codes b WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank,
       vec_id, distance
FROM pairs QUALIFY rank <= {NEAREST}
"""


def _licenses_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    plain = lambda text: [w.decode() for w in _words(text)]
    templates = ",\n        ".join(f"({n}, '{label}', {quoted(sorted(set(plain(t))))}, {window(len(plain(t)))})"
                               for n, (label, t) in enumerate(TEMPLATES))
    phrases = ",\n        ".join(f"('{label}', {quoted(plain(p))})" for p, label in PHRASES)
    words = (r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
WITH templates(t, label, wanted, wide) AS (VALUES
        {templates}),
phrases(label, phrase) AS (VALUES
        {phrases}),
split AS MATERIALIZED (
    SELECT doc_id, {words.format("coalesce(text, '')")} AS words FROM documents),
places AS (
    SELECT doc_id, label, unnest(list_filter(range(0, len(words)),
        lambda i: words[i + 1:i + len(phrase)] = phrase)) AS place
    FROM split, phrases WHERE list_has_all(words, phrase)),
base AS (
    SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
           list_sort(list(DISTINCT label)) AS labels
    FROM places GROUP BY doc_id),
listed AS (
    SELECT t, label, len(wanted) AS n, wide, unnest(wanted) AS word FROM templates),
places_of_words AS (
    SELECT doc_id, generate_subscripts(words, 1) AS p, unnest(words) AS word FROM split),
blocks AS (
    SELECT doc_id, label, n, count(DISTINCT word) OVER (
        PARTITION BY doc_id, t ORDER BY p RANGE BETWEEN CURRENT ROW AND wide - 1 FOLLOWING) AS shared
    FROM places_of_words JOIN listed USING (word)),
met AS (
    SELECT DISTINCT doc_id, label, shared / n AS share
    FROM blocks WHERE shared >= ceil({CONTAINMENT} * n - 1e-9)),
best AS (
    SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM met GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(
           coalesce(base.labels, []), coalesce(best.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best.share, 0.0) END::DOUBLE AS score
FROM split LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)
"""


COLLOCATIONS_SQL = rf"""
WITH pieces AS (
    SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
split AS MATERIALIZED (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM split GROUP BY lang),
grams AS (
    SELECT lang, size, array_to_string(words[p:p + size - 1], ' ') AS phrase
    FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS p
          FROM split, range(1, {LONGEST + 1}) AS sizes(size) WHERE len(words) >= size)),
counts AS MATERIALIZED (
    SELECT lang, size, phrase, string_split(phrase, ' ') AS words, count(*)::HUGEINT AS f
    FROM grams GROUP BY lang, size, phrase HAVING count(*) >= {SUPPORT}),
cuts AS (
    SELECT lang, phrase, words, size, f AS a, unnest(range(1, size)) AS k FROM counts WHERE size > 1),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score
    FROM cuts c
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.k], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.k + 1:], ' ')
    JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, array_to_string(words[s:s + m - 1], ' ') AS phrase, max(f) AS longer
    FROM (SELECT lang, words, f, m, unnest(range(1, size - m + 2)) AS s
          FROM (SELECT lang, words, f, size, unnest(range(2, size)) AS m FROM counts WHERE size > 2))
    GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best LEFT JOIN inside USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < {SUBSUMED} * a
QUALIFY rank <= {TOP}
"""


def _chat_sql() -> str:
    """Digests of the turns themselves; the length of the output from a hand-written
    list of what the markers add."""
    text = "replace(coalesce({}, ''), '\\', '\\\\')"
    for c in chat.DEFAULT.control():
        text = f"replace({text}, '{c}', '{c[0]}\\{c[1:]}')"
    return f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           {text.format("text")} AS shown, {text.format("role")} AS shown_role
    FROM (SELECT conv_id, turn, role, text FROM conversations
          UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')),
sized AS (
    SELECT *, length(shown) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 4
                              ELSE length(shown_role) + 19 END AS size,
           CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'o' END AS letter
    FROM said),
whole AS (
    SELECT conv_id, count(*)::BIGINT AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, shown)) AS turns_sha256,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, shown) FILTER (role = 'assistant'), '') AS trained,
           3 + sum(size) AS formatted_chars,
           string_agg(letter, '' ORDER BY turn NULLS FIRST, role, shown) AS letters
    FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(trained)::BIGINT AS loss_chars, sha256(trained) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars, regexp_full_match(letters, 's?(ua)+') AS valid,
       CASE WHEN NOT regexp_full_match(letters, 's?(ua)+')
            THEN length(regexp_extract(letters, '^s?(ua)*u?'))::BIGINT END AS refused_at
FROM whole
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substrings": SUBSTRINGS_SQL, "op6_licenses": _licenses_sql(),
            "op7_hamming_top_k": HAMMING_SQL, "op11_collocations": COLLOCATIONS_SQL,
            "op12_chat_format": _chat_sql()}
