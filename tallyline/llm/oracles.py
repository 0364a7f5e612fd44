"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tallyline.llm import quality_rules as q
from tallyline.llm import url_filter as u

WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def quality_rules() -> str:
    """Counts by unnesting windows, distances over lists of shares."""
    classes = ", ".join(f"length(regexp_replace(t, '[^{m.replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for m in q.CLASSES.values())
    cases = " ".join(f"WHEN '{k}' THEN {listed(v.split())}" for k, v in q.COMMON_WORDS.items())
    js = (
        "sqrt(greatest(0.0, list_sum(list_transform(list_zip({a}, {b}), lambda z: ("
        "CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + "
        "CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END) / 2))))"
    )
    share = "list_transform({h}, lambda x: x / list_sum({h})::DOUBLE)"
    of_class = js.format(a=share.format(h="classes"), b=share.format(h="class_reference"))
    of_words = js.format(a=share.format(h="word_counts"), b=share.format(h="word_reference"))
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents
), split AS (
  SELECT *, {WORDS} AS w, CASE lang {cases} ELSE []::VARCHAR[] END AS listed FROM texts
), windows AS (
  SELECT row_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {{'p': i, 'w': w[i] || ' ' || w[i+1] || ' ' || w[i+2]}}), recursive := true)
  FROM split WHERE len(w) >= 3
), often AS (
  SELECT row_id, p FROM (SELECT *, count(*) OVER (PARTITION BY row_id, w) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT row_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT row_id, unnest([p, p + 1, p + 2]) AS p FROM often) GROUP BY row_id
), part AS (
  SELECT row_id, doc_id, lang, len(w) AS n_words, length(t) AS n_chars,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
    [{classes}] AS most,
    list_transform(listed, lambda k: len(list_filter(w, lambda x: octet_length(encode(x)) <= {q.longest(q.COMMON_WORDS)} AND lower(x) = k))) AS hits
  FROM split
), counted AS (
  SELECT doc_id, lang, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    list_append(most, n_chars - list_sum(most)) AS classes,
    list_append(hits, n_words - coalesce(list_sum(hits), 0)) AS word_counts,
    n_words < {q.MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {q.MAX_REPEATED_PERCENT} * n_words AS base_failed
  FROM part LEFT JOIN repeated USING (row_id)
), class_sums AS (
  SELECT lang, list(n ORDER BY i) AS class_reference FROM (
    SELECT lang, i, sum(classes[i]) AS n FROM counted, range(1, {len(q.CLASSES) + 2}) r(i) WHERE NOT base_failed GROUP BY lang, i
  ) GROUP BY lang
), word_sums AS (
  SELECT lang, list(n ORDER BY i) AS word_reference FROM (
    SELECT lang, i, sum(word_counts[i]) AS n FROM counted, range(1, 40) r(i) WHERE NOT base_failed AND i <= len(word_counts) GROUP BY lang, i
  ) GROUP BY lang
), far AS (
  SELECT c.*,
    CASE WHEN list_sum(classes) >= {q.MIN_CLASS_CHARS} AND class_reference IS NOT NULL THEN {of_class} END AS class_distance,
    CASE WHEN n_words >= {q.MIN_LIST_WORDS} AND len(word_reference) > 1 THEN {of_words} END AS word_distance
  FROM counted c LEFT JOIN class_sums USING (lang) LEFT JOIN word_sums USING (lang)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= {q.MAX_CLASS_DISTANCE}
    AND coalesce(word_distance, 0) <= {q.MAX_WORD_DISTANCE} AS kept
FROM far
"""


def url_filter_sql() -> str:
    """All rules on all URLs, without an index. Host rules are compared as strings."""
    blocked = " OR ".join(
        "regexp_matches(judged, '" + r.pattern.replace(r"\Z", r"\z").replace("'", "''") + "', 's')" for r in u.PATTERN_RULES
    )
    hosts = ", ".join(
        f"('{r.name}', '{r.name.partition('/')[0]}', '/{r.name.partition('/')[2]}', '{r.verdict}')" for r in u.HOST_RULES
    )
    return rf"""
WITH given AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)([^?#]*)(\?[^#]*)?', ['given', 'path', 'query']) AS c FROM given
), parts AS (
  SELECT row_number() OVER () AS row_id, page_id, c.path AS path, c.query AS query,
    translate(c.given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (VALUES {hosts}
), fitting AS (
  SELECT row_id, rule, verdict FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), best AS (
  SELECT row_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fitting GROUP BY row_id
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT *, host || path || query AS judged FROM parts) LEFT JOIN best USING (row_id)
"""


def pivot_search_sql() -> str:
    """Every query against every vector."""
    return """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


def lexical_search_sql() -> str:
    """Every item against every document that has one of its terms."""
    found = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH items AS (
  SELECT row_number() OVER () AS item, item_id, {found.format(t="text")} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (
  SELECT item, term, count(*) AS times FROM (SELECT item, unnest(terms) AS term FROM items) GROUP BY item, term
), texts AS (
  SELECT row_number() OVER () AS doc, doc_id, {found.format(t="text")} AS terms FROM documents
), lengths AS (
  SELECT doc, doc_id, len(terms) AS n FROM texts WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS docs, sum(n) AS all_terms FROM lengths
), counts AS (
  SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM texts)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals GROUP BY term, docs
), valued AS (
  SELECT doc, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // all_terms))) AS value
  FROM counts JOIN lengths USING (doc), totals
), scored AS (
  SELECT item, doc, doc_id, sum(times * w * value)::BIGINT AS score
  FROM asked JOIN valued USING (term) JOIN weights USING (term) GROUP BY item, doc, doc_id
)
SELECT item_id::BIGINT AS item_id, rank::INTEGER AS rank, doc_id::BIGINT AS doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) JOIN items USING (item) WHERE rank <= 20
"""


def collocations_sql() -> str:
    """All phrases of one to three words, and every longer one of each."""
    return r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL)
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), phrases AS (
  SELECT lang, unnest(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) AS phrase
  FROM worded WHERE len(w) > 0
), counted AS (
  SELECT lang, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM phrases GROUP BY lang, phrase
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE len(w) = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM counted WHERE len(w) > 1 AND a >= 10
), cuts AS (
  SELECT lang, phrase, a, w, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k+1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.w, k, h.a AS l, t.a AS r, (1000000::HUGEINT * c.a * c.a) // (h.a::HUGEINT * t.a) AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = head JOIN counted t ON t.lang = c.lang AND t.phrase = tail
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, part AS phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE len(w) = 3)
  GROUP BY lang, part
), kept AS (
  SELECT s.* FROM worst s LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * longer < 50 * a, true)
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
) JOIN totals USING (lang) WHERE rank <= 2000
"""


ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules(),
    "op7_url_filter": url_filter_sql(),
    "op8_pivot_search": pivot_search_sql(),
    "op11_lexical_search": lexical_search_sql(),
    "op12_collocations": collocations_sql(),
}
