"""DuckDB SQL for the corpus queries that SQL can express: other formulations of the same contracts."""

from __future__ import annotations

from .decontaminate import LEAST, MASKS, PENALTY, SIMILAR
from .licenses import CONTAINED, PHRASES, TEMPLATES
from .periodic_runs import LEAST as RUN
from .quality_rules import GRAM_LIMITS, LINE_LIMIT, MIN_WORDS, MOST_REPEATED, WINDOW
from .substring_dedup import WINDOW as LENGTH

_WORD = r"[^\x20\x09-\x0D]+"


def _op1() -> str:
    tokens = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"
    seed = lambda k, m, w, i: f"'{k}' || " + " || ' ' || ".join(f"{w}[{i} + {p + 1}]" for p in m)

    def seeds(table: str, key: str) -> str:
        parts = [
            f"SELECT {key}, i, {seed(k, m, 'w', 'i')} AS seed FROM (SELECT {key}, w, unnest(range(0, len(w) - {m[-1]})) AS i FROM {table} WHERE len(w) > {m[-1]})"
            for k, m in enumerate(MASKS)
        ]
        return " UNION ALL ".join(parts)

    return f"""WITH d AS (SELECT doc_id, string_split({tokens}, ' ') AS w FROM documents WHERE {tokens} <> ''),
 b AS (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, string_split({tokens}, ' ') AS w FROM benchmark WHERE {tokens} <> '') GROUP BY w),
 bs AS ({seeds('b', 'item_id')}), ds AS ({seeds('d', 'doc_id')}),
 hits AS (SELECT DISTINCT ds.doc_id, bs.item_id, ds.i - bs.i AS diagonal FROM ds JOIN bs USING (seed)),
 agree AS (SELECT h.doc_id, h.item_id, h.diagonal, list_transform(range(0, len(b.w)), lambda j: h.diagonal + j >= 0 AND coalesce(d.w[h.diagonal + j + 1] = b.w[j + 1], false)) AS a
  FROM hits h JOIN d USING (doc_id) JOIN b USING (item_id)),
 scored AS (SELECT *, len(list_filter(a, lambda x: x)) AS n_matched, len(a) AS n_item_tokens,
  list_max(list_transform(range(0, len(a)), lambda i: list_max(list_transform(range(i, len(a)), lambda j: CASE WHEN list_bool_and(list_transform(range(i, j + 1), lambda e:
   len(list_filter(a[i + 1 : e + 1], lambda x: x)) - {PENALTY} * len(list_filter(a[i + 1 : e + 1], lambda x: NOT x)) >= 0)) THEN len(list_filter(a[i + 1 : j + 1], lambda x: x)) ELSE 0 END)))) AS longest FROM agree),
 good AS (SELECT *, n_matched / n_item_tokens::DOUBLE AS similarity FROM scored WHERE n_matched / n_item_tokens::DOUBLE >= {SIMILAR} OR longest >= {LEAST})
 SELECT doc_id, item_id, greatest(diagonal, 0)::BIGINT AS start_token, n_matched::BIGINT AS n_matched, n_item_tokens::BIGINT AS n_item_tokens, round(similarity, 6) AS similarity, longest::BIGINT AS longest
 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, diagonal) AS k FROM good) WHERE k = 1"""


def _op3() -> str:
    sizes = sorted({*GRAM_LIMITS, WINDOW})
    marks = [
        f"""g{k} AS (SELECT doc_id, i, {k} AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + {k - 1}], ' ')) AS c
 FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k})) WHERE c > 1),
 c{k} AS (SELECT doc_id, count(*) AS n, sum(length(d.w[p])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS p FROM g{k}) JOIN d USING (doc_id) GROUP BY 1)"""
        for k in sizes
    ]
    join = " ".join(f"LEFT JOIN c{k} USING (doc_id)" for k in sizes)
    share = lambda k: f"coalesce(c{k}.chars, 0) / greatest(d.word_chars, 1)::DOUBLE"
    fails = " OR ".join(f"{share(k)} > {limit}" for k, limit in GRAM_LIMITS.items())
    most = ", ".join(share(k) for k in GRAM_LIMITS)
    return f"""WITH d AS (SELECT doc_id, text, w, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents)),
 {", ".join(marks)},
 l AS (SELECT doc_id, n, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM (SELECT doc_id, text, 1 AS n FROM d)),
 m AS (SELECT doc_id, length(line) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup FROM l WHERE regexp_matches(line, '{_WORD}')),
 n AS (SELECT doc_id, count(*) FILTER (WHERE dup) AS dups, coalesce(sum(chars) FILTER (WHERE dup), 0) AS dup_chars, sum(chars) AS all_chars FROM m GROUP BY 1),
 o AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(d.word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n.dups, 0)::BIGINT AS n_dup_lines,
 coalesce(c{WINDOW}.n, 0)::BIGINT AS n_repeat_words, greatest({most}) AS gram_coverage, coalesce(n.dup_chars, 0) / greatest(coalesce(n.all_chars, 0), 1)::DOUBLE AS line_coverage, {fails} AS fails
 FROM d LEFT JOIN n USING (doc_id) {join})
 SELECT * EXCLUDE (fails), n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
 NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words OR fails OR line_coverage > {LINE_LIMIT}) AS kept FROM o"""


def _op6() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES.items())
    return f"""WITH t AS (SELECT doc_id, {lower} AS text FROM documents), d AS (SELECT doc_id, text, regexp_extract_all(text, '{word}') AS w FROM t),
 p(phrase, k, label) AS (VALUES {phrases}), q AS (SELECT label, list_distinct(string_split(text, ' ')) AS own FROM (VALUES {templates}) v(label, text)),
 s AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
 h AS (SELECT s.doc_id, s.i, p.label FROM s JOIN p ON s.w[s.i + 1] = string_split(p.phrase, ' ')[1] AND array_to_string(s.w[s.i + 1 : s.i + p.k], ' ') = p.phrase),
 places AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, list(DISTINCT label) AS labels FROM h GROUP BY 1),
 l AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{word}')) AS own FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)),
 c AS (SELECT l.doc_id, q.label, len(list_intersect(l.own, q.own)) / len(q.own)::DOUBLE AS share FROM l, q WHERE len(list_intersect(l.own, q.own)) / len(q.own)::DOUBLE >= {CONTAINED}),
 held AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM c GROUP BY 1)
 SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_base, places.a AS first_word, places.b AS last_word,
 coalesce(array_to_string(list_sort(places.labels), ','), '') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(places.labels, []), coalesce(held.labels, [])))), ',') AS labels,
 CASE WHEN places.n > 0 THEN 1.0::DOUBLE ELSE coalesce(held.share, 0.0) END AS score FROM d LEFT JOIN places USING (doc_id) LEFT JOIN held USING (doc_id)"""


_OP9 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
 SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

_OP10 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
 s AS (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d WHERE len(w) >= {LENGTH}),
 k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + {LENGTH - 1}], ' ') ORDER BY doc_id, i) > 1 AS later FROM s),
 gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + {LENGTH})) AS p FROM k WHERE later) GROUP BY 1),
 kept AS (SELECT d.doc_id, w, coalesce(len(p), 0) AS n, CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END AS v FROM d LEFT JOIN gone USING (doc_id))
 SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(v, ' ')) AS kept_sha256 FROM kept"""


def _op11() -> str:
    crc = "(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: unicode(substr(k, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, e: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))))"
    # Every run holds two equal stretches of 6 words, q apart: 12 words at least, and twice q.
    return f"""WITH t AS (SELECT doc_id, doc_id::VARCHAR AS k, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
 h AS (SELECT doc_id, w, len(w)::BIGINT AS n, xor({crc}, 4294967295) AS h FROM t), g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
 p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
 d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(w, lambda x, i: CASE WHEN i - 1 < a THEN x ELSE w[1 + a + (i - 1 - a) % p] END) ELSE w END AS w FROM p),
 s AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM d WHERE n >= {RUN})),
 m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
 v AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM m) GROUP BY doc_id, q, isle),
 c AS (SELECT * FROM v WHERE length >= greatest({RUN}, 2 * q)),
 r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.q < c.q AND o.start <= c.start AND o.start + o.length >= c.start + c.length)),
 b AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, q := q), struct_pack(l := -length, s := start, q := q)) AS best,
  string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM r GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
 words AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, n)) AS i FROM d WHERE n > 0),
 kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS line FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
 SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
 sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256 FROM d LEFT JOIN b USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _op13() -> str:
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
 l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
 f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {{'A': (len(w) < 50)::INT, 'B': (100 * len(list_distinct(w)) < 65 * len(w))::INT, 'C': (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT,
  'D': regexp_matches(text, '[#$%&*|]')::INT, 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT}} AS fails FROM d LEFT JOIN l USING (doc_id)),
 m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
 x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
 r AS (SELECT part, filter_order, step, n, good, toxic, fails[substr(filter_order, step, 1)] AS own, list_sum(list_transform(range(1, step), lambda i: fails[substr(filter_order, i, 1)])) AS before,
  list_sum(map_values(fails)) AS fails FROM m, s),
 g AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, sum(CASE WHEN own = 0 AND coalesce(before, 0) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN own = 1 AND coalesce(before, 0) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN own = 1 AND before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own = 1 AND fails = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN own = 1 AND coalesce(before, 0) = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own = 1 AND coalesce(before, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY 1, 2, 3)
 SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM g"""


def oracle_sql() -> dict[str, str]:
    return {"op11_periodic_runs": _op11(), "op13_filter_audit": _op13(), "op1_decontamination": _op1(), "op3_quality_rules": _op3(), "op6_licenses": _op6(), "op9_warc": _OP9, "op10_substring_dedup": _OP10}
