"""DuckDB SQL that gives the rows of the registered queries, from the stored tables alone."""

from __future__ import annotations

from ..functions.prompts import RULES
from ..functions.words import COMMON_ENGLISH, ENGLISH_OPENINGS, SPACE, STOPWORDS, TITLES, WORD


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(set(words))) + ")"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def _upper(x: str) -> str:
    return f"translate({x}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def _runs(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[^{WORD}]+'), lambda w: w <> '')"


def _sentences(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[.!?]+{SPACE}+'), lambda z: regexp_matches(z, '[^{SPACE[1:-1]}]'))"


_TOKENS = "greatest(1, ceil(length(text) / 4.0::DOUBLE))::INTEGER"
_SEP = "((length({0}) - length(replace({0}, '</>', ''))) // 3)"
_QUOTES = "((length({0}) - length(translate({0}, '“”«»', ''))) // 2)"
_UPPER = r"regexp_matches({0}, '^\p{{Lu}}')"
_KEY = "doc_id::VARCHAR || '/' || pos::VARCHAR"

_LINES = f"""lines AS (
    SELECT doc_id, pos, text FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents) z
    WHERE regexp_matches(text, '[^{SPACE[1:-1]}]'))"""
_MOCK = f"""{_LINES}, m1 AS (
    SELECT doc_id, pos, doc_id * 31 + pos AS h, CASE WHEN (doc_id * 31 + pos) % 5 = 0 THEN replace(text, ', ', ', </>') ELSE text END AS o FROM lines),
m2 AS (SELECT *, CASE WHEN h % 4 = 0 THEN '“' || o || '”' ELSE o END AS original FROM m1),
m3 AS (SELECT *, CASE WHEN h % 7 = 0 THEN original ELSE translate(original, 'etn', 'axk') END AS t0 FROM m2),
m4 AS (SELECT *, CASE WHEN h % 11 = 0 THEN replace(t0, '</>', '') ELSE t0 END AS t1 FROM m3),
mock AS (SELECT doc_id, pos, h, original, CASE WHEN h % 17 <> 0 THEN CASE WHEN h % 13 = 0 THEN translate(t1, '“”', '') ELSE translate(t1, '“”', '«»') END END AS translated FROM m4)"""
_PAIRS = """pairs AS (
    SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS original, a.text AS translated
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _terms(x: str) -> str:
    raw = f"list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> '')"
    return f"""list_sort(list_distinct(list_concat(
        list_transform(list_filter(list_transform({raw}, lambda w, i: {{'w': regexp_replace(w, '[^{WORD}]', '', 'g'), 'i': i, 'n': coalesce(({raw})[i + 1], '')}}),
            lambda s: length(s.w) >= 2 AND s.w NOT IN {_in(TITLES)} AND {_UPPER.format("s.w")} AND (s.i > 1 OR {_UPPER.format("s.n")})), lambda s: s.w),
        list_filter({_runs(x)}, lambda w: regexp_full_match(w, '[A-Z]{{2,}}')),
        list_filter({_runs(x)}, lambda w: regexp_full_match(w, '[A-Z][a-z]+[A-Z][a-zA-Z]*')))))"""


_TERMS = f"""{_PAIRS}, termed AS (SELECT *, {_terms("original")} AS ot, {_terms("translated")} AS tt FROM pairs)"""
_ALIGN = f"""{_TERMS}, o AS (
    SELECT pair_id, original, translated, tt, unnest(ot) AS source, unnest(range(0, len(ot))) AS seq FROM termed),
kept AS (SELECT pair_id, seq, source, source AS target, NULL::DOUBLE AS score FROM o WHERE instr(translated, source) > 0),
cand AS (SELECT *, unnest(tt) AS c, unnest(range(0, len(tt))) AS ci FROM o WHERE instr(translated, source) = 0),
scored AS (
    SELECT *, CASE WHEN instr(translated, c) > 0 THEN (1.0::DOUBLE - abs((instr(original, source) - 1)::DOUBLE / length(original) - (instr(translated, c) - 1)::DOUBLE / length(translated))) * 2.0::DOUBLE ELSE 0.0::DOUBLE END
        + least(length(source), length(c))::DOUBLE / greatest(length(source), length(c))
        + CASE WHEN lower(source[1:1]) = lower(c[1:1]) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM cand),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, seq ORDER BY score DESC, ci) AS rn FROM scored) z WHERE rn = 1 AND score >= 1.0),
aligned AS (SELECT pair_id, seq, source, target, score FROM kept UNION ALL SELECT pair_id, seq, source, c, score FROM best),
obs AS (SELECT source, target, pair_id * 100000 + seq AS seq FROM aligned)"""
_EXCLUDED = r"(lower(source) IN {0} OR length(source) <= 1 OR (length(source) = 2 AND regexp_matches(source, '^\p{{Ll}}')))".format(_in(STOPWORDS))
_VOTES = f"""counted AS (
    SELECT source, target, count(*) AS cnt, min(seq) AS first_seen FROM obs WHERE NOT {_EXCLUDED} GROUP BY 1, 2),
modes AS (
    SELECT source, target, cnt, total, n_targets, first_seen FROM (
        SELECT source, target, cnt, sum(cnt) OVER (PARTITION BY source)::BIGINT AS total, count(*) OVER (PARTITION BY source) AS n_targets, min(first_seen) OVER (PARTITION BY source) AS first_seen,
            row_number() OVER (PARTITION BY source ORDER BY cnt DESC, first_seen) AS rn FROM counted) z WHERE rn = 1),
validated AS (SELECT source, target FROM modes WHERE length(source) = 7),
conflicts AS (
    SELECT m.source, m.n_targets, m.cnt::DOUBLE / m.total AS dominant_ratio, l.targets FROM modes m
    JOIN (SELECT source, list(target ORDER BY cnt DESC, first_seen) AS targets FROM counted GROUP BY source) l ON l.source = m.source
    WHERE m.n_targets >= 2 AND m.cnt::DOUBLE / m.total < 0.7::DOUBLE)"""
_COUNTS = f"{_ALIGN}, {_VOTES}"
_ISSUES = f"""{_ALIGN}, named AS (SELECT {_collapse("source")} AS source, {_collapse("target")} AS target, seq FROM obs),
per AS (SELECT source, target, count(*) AS cnt, min(seq) AS f FROM named WHERE source <> target GROUP BY 1, 2),
tops AS (
    SELECT source, target, cnt, count(*) OVER (PARTITION BY source) AS n_targets, sum(cnt) OVER (PARTITION BY source) AS seen,
        row_number() OVER (PARTITION BY source ORDER BY cnt DESC, f) AS rn FROM per),
issues AS (
    SELECT source, n_targets, round(confidence, 9) AS confidence, target AS suggestion FROM (
        SELECT *, CASE WHEN n_targets < 2 THEN 0.0::DOUBLE WHEN cnt::DOUBLE / seen > 0.8::DOUBLE THEN 0.7::DOUBLE ELSE least(0.7::DOUBLE + 0.1::DOUBLE * (n_targets - 2), 1.0::DOUBLE) END AS confidence
        FROM tops WHERE rn = 1) z WHERE n_targets >= 2 AND seen >= 2 AND confidence >= 0.7::DOUBLE)"""


def _english(x: str) -> str:
    low = f"lower({x})"
    words = f"list_filter({_runs(low)}, lambda w: regexp_full_match(w, '[a-z]+'))"
    hits = " + ".join(f"CASE WHEN regexp_matches({low}, '(^|[^{WORD}])({alt}){SPACE}{'+[' + WORD + ']' if word else ''}') THEN 1 ELSE 0 END" for alt, word in ENGLISH_OPENINGS)
    return f"""CASE WHEN len({words}) = 0 THEN 0.0::DOUBLE ELSE least(0.6::DOUBLE * (len(list_filter({words}, lambda w: w IN {_in(COMMON_ENGLISH)}))::DOUBLE / len({words}))
        + 0.3::DOUBLE * (({hits})::DOUBLE / 5.0::DOUBLE) + least(len({words})::DOUBLE / 10.0::DOUBLE, 0.2::DOUBLE), 1.0::DOUBLE) END"""


_SENT = f"""sent AS (
    SELECT doc_id, lang, unnest(s) AS sentence, unnest(range(0, len(s))) AS position FROM (SELECT doc_id, lang, {_sentences("text")} AS s FROM documents) z)"""
_UNTRANSLATED = f"""{_SENT}, untranslated AS (
    SELECT doc_id, position, {_collapse("sentence")} AS sentence, round(c, 9) AS confidence FROM (SELECT *, {_english("sentence")} AS c FROM sent) z WHERE c >= 0.6::DOUBLE)"""
_BODY = f"""{_LINES}, f AS (
    SELECT doc_id AS book, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seq, {_TOKENS} AS tok, text FROM lines),
folded AS (
    SELECT book, seq, tok, CASE WHEN tok > 300 THEN 1 ELSE 0 END AS chunk_id, tok AS held FROM f WHERE seq = 0
    UNION ALL
    SELECT f.book, f.seq, f.tok, CASE WHEN folded.held + f.tok > 300 THEN folded.chunk_id + 1 ELSE folded.chunk_id END, CASE WHEN folded.held + f.tok > 300 THEN f.tok ELSE folded.held + f.tok END
    FROM folded JOIN f ON f.book = folded.book AND f.seq = folded.seq + 1),
body AS (
    SELECT folded.book, folded.seq, chunk_id, folded.tok, coalesce(sum(folded.tok) OVER (PARTITION BY folded.book ORDER BY folded.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, f.text
    FROM folded JOIN f ON f.book = folded.book AND f.seq = folded.seq),
starts AS (SELECT book, chunk_id AS k, min(seq) AS s, min(before) AS p, arg_min(before + tok, seq) AS p1 FROM body GROUP BY 1, 2),
tails AS (
    SELECT b.book, n.k - 1 AS chunk_id, b.seq FROM body b JOIN starts n ON n.book = b.book WHERE n.k >= 1 AND b.seq > n.s AND b.before - n.p1 < 150),
heads AS (
    SELECT b.book, a.k AS chunk_id, b.seq FROM body b JOIN starts n ON n.book = b.book AND n.k = b.chunk_id + 1 JOIN starts a ON a.book = b.book
    WHERE b.seq < a.s AND a.p - b.before < 150 AND (b.chunk_id = a.k - 1 OR a.p1 - n.p1 < 150)),
members AS (
    SELECT h.book, h.chunk_id, 0 AS role, h.seq, b.text FROM heads h JOIN body b ON b.book = h.book AND b.seq = h.seq
    UNION ALL SELECT book, chunk_id, 1, seq, text FROM body
    UNION ALL SELECT t.book, t.chunk_id, 2, t.seq, b.text FROM tails t JOIN body b ON b.book = t.book AND b.seq = t.seq),
placed AS (SELECT *, row_number() OVER (PARTITION BY book, chunk_id, role ORDER BY seq) - 1 AS i FROM members)"""


def _prompt(marked: str) -> str:
    return f"""WITH RECURSIVE {_BODY}
        SELECT book, chunk_id::BIGINT AS chunk_id, string_agg(CASE WHEN {marked} THEN '<' || i::VARCHAR || '/>' || text ELSE text END, chr(10) || chr(10) ORDER BY role, seq) AS prompt FROM placed GROUP BY 1, 2"""


_QUARANTINE = f"""{_MOCK}, q AS (
    SELECT doc_id::VARCHAR AS file_name, pos::VARCHAR AS file_line, doc_id AS chunk_index, pos AS chunk_line,
        CASE WHEN translated IS NULL THEN 'line_count' WHEN {_QUOTES.format("original")} <> {_QUOTES.format("translated")} THEN 'punctuation' WHEN {_SEP.format("original")} <> {_SEP.format("translated")} THEN 'fragment_count' END AS check_name,
        CASE WHEN translated IS NULL THEN 'line_count' WHEN {_QUOTES.format("original")} <> {_QUOTES.format("translated")} THEN 'punctuation' ELSE 'fragment_count' END || ': expected ' || CASE WHEN translated IS NULL THEN '1' WHEN {_QUOTES.format("original")} <> {_QUOTES.format("translated")} THEN {_QUOTES.format("original")}::VARCHAR ELSE ({_SEP.format("original")} + 1)::VARCHAR END
        || ', got ' || CASE WHEN translated IS NULL THEN '0' WHEN {_QUOTES.format("original")} <> {_QUOTES.format("translated")} THEN {_QUOTES.format("translated")}::VARCHAR ELSE ({_SEP.format("translated")} + 1)::VARCHAR END AS reason,
        original AS original_text, coalesce(translated, '') AS translated_text FROM mock),
quarantined AS (SELECT * FROM q WHERE check_name IS NOT NULL)"""
_RENDER = f"""{_LINES}, rendered AS (SELECT doc_id, string_agg('<' || pos::VARCHAR || '/>' || text, chr(10) ORDER BY pos) || chr(10) || '[=[END]=]' AS raw FROM lines GROUP BY doc_id)"""
def _compare(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^{WORD}{SPACE[1:-1]}]', '', 'g'), '{SPACE}+', ' ', 'g'))"


_PHASES = f"""{_MOCK}, initial AS (SELECT {_KEY} AS key, translated AS text FROM mock WHERE translated IS NOT NULL),
refined AS (SELECT {_KEY} AS key, CASE WHEN h % 6 = 0 THEN '' ELSE 'r ' || original END AS text FROM mock WHERE h % 2 = 0)"""

ORACLE_SQL: dict[str, str] = {
    "untranslated_sentences": f"WITH {_UNTRANSLATED} SELECT doc_id, position, sentence, confidence FROM untranslated",
    "language_confidence": f"WITH {_SENT} SELECT lang, count(*) AS n, sum(round(({_english('sentence')}) * 1000000)::BIGINT)::BIGINT AS total_millionths FROM sent GROUP BY lang",
    "copy_detection": f"""WITH {_MOCK}, {_PAIRS}, both_pairs AS (
            SELECT {_KEY} AS key, original, translated FROM mock WHERE translated IS NOT NULL UNION ALL SELECT pair_id::VARCHAR, original, translated FROM pairs),
        keyed AS (SELECT key, {_compare("original")} AS a, {_compare("translated")} AS b FROM both_pairs),
        scored AS (SELECT key, CASE WHEN a = b THEN 1.0::DOUBLE ELSE len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda p: p[1] = p[2] AND p[1] <> ''))::DOUBLE / greatest(length(a), length(b)) END AS s,
            CASE WHEN a = b THEN 'identical' ELSE 'similar' END AS reason_code FROM keyed)
        SELECT key, round(s, 9) AS similarity, reason_code FROM scored WHERE s >= 0.9::DOUBLE""",
    "fragment_count_errors": f"WITH {_MOCK} SELECT doc_id, pos AS line_idx, {_SEP.format('original')} + 1 AS expected, {_SEP.format('translated')} + 1 AS actual FROM mock WHERE {_SEP.format('original')} <> {_SEP.format('translated')}",
    "punctuation_errors": f"WITH {_MOCK} SELECT doc_id, pos AS line_idx, {_QUOTES.format('original')} AS expected_pairs, {_QUOTES.format('translated')} AS actual_pairs FROM mock WHERE {_QUOTES.format('original')} <> {_QUOTES.format('translated')}",
    "line_count_errors": f"""WITH {_MOCK} SELECT doc_id, count(original) AS expected, count(translated) AS actual, count(*) FILTER (WHERE translated IS NULL) AS n_missing,
        string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (WHERE translated IS NULL) AS missing FROM mock GROUP BY doc_id HAVING count(original) <> count(translated)""",
    "quarantine": f"WITH {_QUARANTINE} SELECT * FROM quarantined",
    "validation_stats": f"""WITH {_QUARANTINE}, per AS (SELECT doc_id, count(*) AS n FROM mock GROUP BY 1), bad AS (SELECT chunk_index, count(*) AS bad FROM quarantined GROUP BY 1)
        SELECT CASE WHEN bad IS NULL THEN 'validated' WHEN bad < n THEN 'partial' ELSE 'rejected' END AS status, count(*) AS n FROM per LEFT JOIN bad ON chunk_index = doc_id GROUP BY 1""",
    "parse_output": f"""WITH {_LINES} SELECT doc_id, pos AS line_idx, {_strip("text")} AS text FROM lines
        UNION ALL SELECT DISTINCT doc_id, 0, 'first' FROM lines WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM lines WHERE pos = 0)""",
    "parse_status": f"""WITH {_RENDER}, broken AS (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN replace(raw, '[=[END]=]', '') WHEN 2 THEN '[ERREUR: ' || raw WHEN 3 THEN regexp_replace(raw, '(^|\\n)<', '\\1- <', 'g')
            WHEN 4 THEN chr(10) || chr(9) || raw || chr(10) || ' ' || chr(160) || chr(10) ELSE raw END AS raw FROM rendered),
        stripped AS (SELECT doc_id, raw, {_strip("raw")} AS s FROM broken)
        SELECT doc_id, CASE WHEN starts_with(s, '[ERREUR') THEN 'error' WHEN NOT ends_with(s, '[=[END]=]') THEN 'missing_end' WHEN NOT regexp_matches(s, '(^|\\n)<[0-9]+/>') THEN 'no_lines' ELSE 'ok' END AS status,
            len(list_filter(string_split(raw, chr(10)), lambda x: regexp_matches(x, '^<[0-9]+/>'))) AS n_numbered FROM stripped""",
    "retry_index_check": f"""WITH {_MOCK}, came AS (SELECT doc_id, pos FROM mock WHERE h % 17 <> 0 UNION ALL SELECT doc_id, pos + 1000 FROM mock WHERE h % 19 = 0),
        b AS (SELECT coalesce(m.doc_id, c.doc_id) AS doc_id, CASE WHEN c.pos IS NULL THEN m.pos END AS gone, CASE WHEN m.pos IS NULL THEN c.pos END AS more FROM (SELECT doc_id, pos FROM mock) m FULL JOIN came c ON c.doc_id = m.doc_id AND c.pos = m.pos),
        g AS (SELECT doc_id, list(gone ORDER BY gone) FILTER (WHERE gone IS NOT NULL) AS gone, list(more ORDER BY more) FILTER (WHERE more IS NOT NULL) AS more FROM b GROUP BY 1)
        SELECT doc_id, gone IS NULL AND more IS NULL AS is_valid, coalesce(array_to_string(gone[1:20], ','), '') AS missing, coalesce(array_to_string(more[1:10], ','), '') AS extra FROM g""",
    "store_upsert": f"WITH {_MOCK} SELECT {_KEY} AS key, CASE WHEN h % 3 = 0 THEN 'v2 ' || original ELSE original END AS text FROM mock",
    "store_fallback": f"""WITH {_PHASES} SELECT coalesce(r.key, i.key) AS key, coalesce(nullif(r.text, ''), nullif(i.text, ''), '') AS text,
        CASE WHEN nullif(r.text, '') IS NOT NULL THEN 'refined' WHEN nullif(i.text, '') IS NOT NULL THEN 'initial' ELSE 'none' END AS origin FROM refined r FULL JOIN initial i ON r.key = i.key""",
    "cache_miss": f"WITH {_MOCK} SELECT doc_id AS chunk_id, count(*) FILTER (WHERE translated IS NULL) AS n_missing FROM mock GROUP BY 1 HAVING count(*) FILTER (WHERE translated IS NULL) > 0",
    "segment_body": f"WITH RECURSIVE {_BODY} SELECT book, seq, chunk_id::BIGINT AS chunk_id, tok::BIGINT AS tok, before FROM body",
    "segment_head": f"WITH RECURSIVE {_BODY} SELECT book, chunk_id::BIGINT AS chunk_id, seq FROM heads",
    "segment_tail": f"WITH RECURSIVE {_BODY} SELECT book, chunk_id::BIGINT AS chunk_id, seq FROM tails",
    "chunk_prompt": _prompt("role = 1"),
    "chunk_marked": _prompt("role = 1 AND i % 2 = 1"),
    "term_extract": f"WITH {_TERMS} SELECT pair_id, 'original' AS side, unnest(ot) AS term FROM termed UNION ALL SELECT pair_id, 'translated', unnest(tt) FROM termed",
    "term_alignment": f"WITH {_ALIGN} SELECT pair_id, source, target, round(score, 9) AS score FROM aligned",
    "glossary_counts": f"WITH {_COUNTS} SELECT source, target, cnt FROM counted",
    "glossary_translation": f"WITH {_COUNTS} SELECT source, target, round(cnt::DOUBLE / total, 9) AS confidence FROM modes WHERE cnt::DOUBLE / total >= 0.5::DOUBLE",
    "glossary_conflicts": f"WITH {_COUNTS} SELECT source, n_targets, round(dominant_ratio, 9) AS dominant_ratio, array_to_string(targets, ', ') AS targets FROM conflicts",
    "conflict_category": f"""WITH {_COUNTS}, cat AS (SELECT source, targets, CASE WHEN lower(source) IN {_in(STOPWORDS)} THEN 'grammatical'
            WHEN length(source) <= 4 AND len(list_distinct(string_split(source, ''))) < length(source) THEN 'onomatopoeia'
            WHEN {_UPPER.format("source")} AND len(list_filter(targets, lambda t: NOT {_UPPER.format("t")})) = 0 THEN 'proper_noun' ELSE 'contextual' END AS category FROM conflicts)
        SELECT source, category, CASE WHEN category IN ('grammatical', 'onomatopoeia') THEN 'low' WHEN len(list_filter(targets, lambda t: lower(t) NOT IN {_in(STOPWORDS)})) = 0 THEN 'none' ELSE 'high' END AS priority FROM cat""",
    "glossary_clean": f"WITH {_ALIGN} SELECT source, count(*) AS total, CASE WHEN lower(source) IN {_in(STOPWORDS)} THEN 'stopword' WHEN count(*) < 2 THEN 'low_confidence' ELSE 'kept' END AS status FROM obs GROUP BY source",
    "glossary_stats": f"""WITH {_COUNTS} SELECT 'total_terms' AS metric, count(DISTINCT source) AS value FROM counted UNION ALL SELECT 'unique_translations', count(*) FROM counted
        UNION ALL SELECT 'validated_terms', count(*) FROM validated UNION ALL SELECT 'conflicting_terms', count(*) FROM conflicts WHERE source NOT IN (SELECT source FROM validated)""",
    "glossary_export": f"""WITH {_COUNTS}, top AS (SELECT * FROM modes WHERE cnt::DOUBLE / total >= 0.5::DOUBLE ORDER BY total DESC, first_seen, source LIMIT 50)
        SELECT string_agg(source || ' → ' || target, ', ' ORDER BY total DESC, first_seen, source) AS prompt FROM top""",
    "glossary_dict": f"WITH {_COUNTS} SELECT source, target FROM modes WHERE cnt::DOUBLE / total >= 0.5::DOUBLE OR length(source) = 7",
    "glossary_high_confidence": f"WITH {_COUNTS} SELECT source, target FROM modes WHERE cnt::DOUBLE / total >= 0.8::DOUBLE",
    "glossary_resolved": f"WITH {_COUNTS} SELECT source, target FROM validated UNION ALL SELECT m.source, m.target FROM modes m JOIN conflicts c ON c.source = m.source WHERE m.source NOT IN (SELECT source FROM validated)",
    "terminology_issues": f"WITH {_ISSUES} SELECT * FROM issues",
    "quality_report": f"""WITH {_UNTRANSLATED}, {_ISSUES}, {_VOTES}
        SELECT 'untranslated' AS metric, count(*) AS value FROM untranslated UNION ALL SELECT 'terminology_issues', count(*) FROM issues UNION ALL SELECT 'glossary_conflicts', count(*) FROM conflicts""",
    "html_headings": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS text
        FROM pages WHERE regexp_matches(html, '<h1>[^<]*\S[^<]*</h1>')""",
    "bilingual_inline": f"WITH {_MOCK} SELECT {_KEY} AS key, original || ' | ' || translated AS text FROM mock WHERE translated IS NOT NULL",
    "edge_space": f"""WITH {_MOCK}, e AS (SELECT {_KEY} AS key, CASE WHEN h % 2 = 0 THEN ' ' ELSE '' END || original || CASE WHEN h % 3 = 0 THEN chr(10) ELSE '' END AS o, translated AS t FROM mock WHERE translated IS NOT NULL)
        SELECT key, CASE WHEN t = '' THEN t ELSE CASE WHEN regexp_matches(o, '^{SPACE}') AND NOT regexp_matches(t, '^{SPACE}') THEN ' ' ELSE '' END || t || CASE WHEN regexp_matches(o, '{SPACE}$') AND NOT regexp_matches(t, '{SPACE}$') THEN ' ' ELSE '' END END AS text FROM e""",
    "cache_keys": r"SELECT url, replace(translate(url, '\/', '__'), ':', '') || '_' || md5(url)[1:8] || '.json' AS key FROM pages",
    "spine_scan": "SELECT page_id, page_id * 7919 % 100003 AS spine_pos FROM pages WHERE html IS NOT NULL",
    "conflict_shares": f"""WITH {_COUNTS}, cat AS (SELECT source, CASE WHEN lower(source) IN {_in(STOPWORDS)} OR (length(source) <= 4 AND len(list_distinct(string_split(source, ''))) < length(source)) THEN 'low'
            WHEN len(list_filter(targets, lambda t: lower(t) NOT IN {_in(STOPWORDS)})) = 0 THEN 'none' ELSE 'high' END AS priority FROM conflicts),
        sized AS (SELECT cat.*, m.total, m.first_seen, row_number() OVER (PARTITION BY priority ORDER BY m.total DESC, m.first_seen) AS rn FROM cat JOIN modes m ON m.source = cat.source)
        SELECT c.source, s.priority, c.target, round(c.cnt::DOUBLE / s.total * 100, 6) AS percent, row_number() OVER (PARTITION BY c.source ORDER BY c.cnt DESC, c.first_seen) AS place
        FROM counted c JOIN sized s ON s.source = c.source WHERE s.priority <> 'low' OR s.rn <= 5""",
    "glossary_sample": f"WITH {_COUNTS} SELECT source, target FROM modes WHERE cnt::DOUBLE / total >= 0.8::DOUBLE ORDER BY source LIMIT 10",
    "glossary_gate": f"""WITH {_COUNTS}, keep AS (SELECT source FROM obs GROUP BY source HAVING count(*) >= 2 AND lower(source) NOT IN {_in(STOPWORDS)}),
        v AS (SELECT source, target FROM validated UNION SELECT m.source, m.target FROM modes m JOIN conflicts c ON c.source = m.source WHERE m.source IN (SELECT source FROM keep))
        SELECT source, target FROM v UNION SELECT source, target FROM modes WHERE cnt::DOUBLE / total >= 0.5::DOUBLE AND source IN (SELECT source FROM keep) AND source NOT IN (SELECT source FROM v)""",
    "store_file_counts": f"""WITH {_MOCK} SELECT 'initial' AS phase, count(DISTINCT doc_id) AS n_files, count(*) AS n_lines FROM mock WHERE translated IS NOT NULL
        UNION ALL SELECT 'refined', count(DISTINCT doc_id), count(*) FROM mock WHERE h % 2 = 0""",
}
ORACLE_SQL["stream_checks"] = ORACLE_SQL["fragment_count_errors"]

_NAME = "'Q' || translate(({0})::VARCHAR, '0123456789', 'abcdefghij')"
_NOUNS = f"""{_PAIRS}, named AS (SELECT pair_id, {_NAME.format("pair_id")} AS one, {_NAME.format("pair_id % 97")} AS two, {_NAME.format("pair_id % 89")} AS other FROM pairs),
nouns AS (SELECT pair_id, [one || ' ' || two, 'NASA', other, two] AS o, [other, 'ESA', one] AS t FROM named)"""
_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_MADE = f"""{_LINES}, made AS (SELECT doc_id AS page_id, pos, pos % 4 AS kind, {_collapse("text")} AS t FROM lines),
grouped AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS frag_index, {_upper("t")} AS u FROM made WHERE kind < 3)"""
_OPEN, _TWIN = 'class="original" style="color: #9ca3af;"', 'class="translation" lang="translated"'


def _block(tag: str, attributes: str, number: str, text: str) -> str:
    """SQL of one element of the made pages: a paragraph with a text, or a heading with a number and a text in bold."""
    opened = f"<{tag} {attributes}>" if attributes else f"<{tag}>"
    if tag == "p":
        return f"'{opened}' || {_ESC.format(text)} || '</p>'"
    return f"'{opened}' || {number} || '<b>' || {_ESC.format(text)} || '</b></h2>'"


def _rewritten(mode: str) -> str:
    old, new = "'n' || pos::VARCHAR", "'N' || pos::VARCHAR"
    out = []
    for kind, tag in ((0, "p"), (1, "h2")):
        if mode == "replace":
            made = _block(tag, "", new, "u")
        elif mode == "inline":
            made = _block(tag, "", f"{old} || ' | ' || {new}", "t || ' | ' || u")
        else:
            made = _block(tag, _OPEN, old, "t") + " || " + _block(tag, _TWIN, new, "u")
        out.append(f"WHEN kind = {kind} AND done THEN {made} WHEN kind = {kind} THEN {_block(tag, '', old, 't')}")
    return f"CASE {' '.join(out)} WHEN kind = 2 THEN '<div>' || {_ESC.format('t')} || '</div>' ELSE '<p> </p>' END"


_HEAD = '<html><head><link rel="stylesheet" href="s.css"></head><body>'
_REWRITE = f"""{_MADE}, placed AS (
    SELECT m.page_id, m.pos, m.kind, m.t, g.u, g.frag_index, coalesce(m.kind < 2 AND g.frag_index % 3 <> 0, false) AS asked FROM made m LEFT JOIN grouped g ON g.page_id = m.page_id AND g.pos = m.pos),
marked AS (SELECT *, asked AND page_id % 10 <> 0 AS done FROM placed),
first_asked AS (SELECT page_id, arg_min(kind + 1, pos) AS parts FROM placed WHERE asked GROUP BY page_id)"""


def _rewrite_of(mode: str) -> str:
    return f"""SELECT m.page_id, '{mode}' AS mode, count(*) FILTER (WHERE done) AS n_groups,
        CASE WHEN m.page_id % 10 = 0 AND any_value(f.parts) IS NOT NULL THEN 'expected ' || any_value(f.parts) || ' fragments, got ' || any_value(f.parts + 1) END AS error,
        md5('{_HEAD}' || string_agg({_rewritten(mode)}, '' ORDER BY pos) || '</body></html>') AS html_md5
        FROM marked m LEFT JOIN first_asked f ON f.page_id = m.page_id GROUP BY m.page_id"""


_BOOKS = """chapters AS (SELECT doc_id, (doc_id % 20)::VARCHAR AS book_id, 'i' || doc_id::VARCHAR AS item_id, doc_id % 7 = 0 AS sheet, text FROM documents WHERE text IS NOT NULL),
spine AS (SELECT item_id, row_number() OVER (PARTITION BY book_id ORDER BY doc_id * 7919 % 100003) - 1 AS spine_pos FROM chapters WHERE NOT sheet)"""
_FILE = "doc_id::VARCHAR || '_' || md5(doc_id::VARCHAR)[1:8] || '.json'"
_JSON = f"{_MOCK}, stored AS (SELECT doc_id, pos, translated FROM mock WHERE translated IS NOT NULL)"
_VALIDITY = f"""{_MOCK}, {_PAIRS}, keyed AS (
    SELECT {_KEY} AS key, original, translated FROM mock WHERE translated IS NOT NULL UNION ALL SELECT 't' || pair_id::VARCHAR, original, translated FROM pairs),
parted AS (SELECT key, unnest({_sentences("translated")}) AS sentence FROM keyed),
english AS (SELECT key, count(*) AS n FROM parted WHERE {_english("sentence")} >= 0.7::DOUBLE GROUP BY key),
compared AS (SELECT key, {_compare("original")} AS a, {_compare("translated")} AS b FROM keyed),
copied AS (SELECT key, CASE WHEN a = b THEN true ELSE len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda p: p[1] = p[2] AND p[1] <> ''))::DOUBLE / greatest(length(a), length(b)) >= 0.9::DOUBLE END AS is_copy FROM compared)"""
_REPAIR = f"""{_MOCK}, gaps AS (SELECT doc_id, count(*) AS k FROM mock WHERE translated IS NULL GROUP BY doc_id),
r AS (SELECT m.*, k, length(original) AS n, {_QUOTES.format("original")} <> {_QUOTES.format("translated")} AS q, {_SEP.format("original")} <> {_SEP.format("translated")} AS f, {_strip(_upper("original"))} AS mended FROM mock m LEFT JOIN gaps g ON g.doc_id = m.doc_id),
judged AS (SELECT *, CASE WHEN translated IS NULL AND k % 5 = 0 THEN 'line_count' WHEN translated IS NOT NULL AND n % 7 = 0 AND q THEN 'punctuation' WHEN translated IS NOT NULL AND n % 7 = 0 AND f THEN 'fragment_count' END AS check_name FROM r)"""
_TWO = f"""{_BODY}, sized AS (SELECT book, chunk_id, count(*) AS n FROM body GROUP BY 1, 2),
firsts AS (SELECT b.book, b.seq, s.n, b.chunk_id, CASE WHEN b.book % 3 = 0 THEN 'c ' || b.text ELSE {_strip(_upper("b.text"))} END AS initial FROM body b JOIN sized s ON s.book = b.book AND s.chunk_id = b.chunk_id)"""

ORACLE_SQL |= {
    "proper_nouns": f"WITH {_NOUNS} SELECT pair_id, unnest(range(0, len(o))) AS pos, unnest(o) AS noun FROM nouns",
    "paired_nouns": f"WITH {_NOUNS} SELECT unnest(o[1:3]) AS source, unnest(t) AS target, pair_id * 100000 + unnest(range(0, 3)) AS seq FROM nouns",
    "validate_only": f"""WITH {_MOCK}, e AS (
        SELECT doc_id, pos, 'line_count' AS check_name, 1 AS expected, 0 AS actual FROM mock WHERE translated IS NULL
        UNION ALL SELECT doc_id, pos, 'punctuation', {_QUOTES.format("original")}, {_QUOTES.format("translated")} FROM mock WHERE {_QUOTES.format("original")} <> {_QUOTES.format("translated")}
        UNION ALL SELECT doc_id, pos, 'fragment_count', {_SEP.format("original")} + 1, {_SEP.format("translated")} + 1 FROM mock WHERE {_SEP.format("original")} <> {_SEP.format("translated")})
        SELECT *, check_name || ': expected ' || expected || ', got ' || actual AS reason FROM e""",
    "html_made_fragments": f"""WITH {_MADE} SELECT page_id, frag_index, CASE kind WHEN 0 THEN 'p' ELSE 'h2' END AS root_tag, kind + 1 AS n_parts,
        CASE kind WHEN 0 THEN t ELSE 'n' || pos::VARCHAR || '</>' || t END AS text FROM grouped WHERE kind < 2""",
    "html_made_rewrite": f"WITH {_REWRITE} " + " UNION ALL ".join(map(_rewrite_of, ("replace", "inline", "separate"))),
    "html_items": f"""WITH {_REWRITE} SELECT page_id, md5('<body>' || string_agg({_rewritten("replace").replace(" AND done", " AND false")}, '' ORDER BY pos) || '</body>') AS content_md5,
        'stylesheet' AS rel, 's.css' AS href, NULL AS type FROM marked GROUP BY page_id""",
    "epub_items": f"""WITH {_BOOKS} SELECT book_id, c.item_id, c.item_id || CASE WHEN sheet THEN '.css' ELSE '.xhtml' END AS file_name, CASE WHEN sheet THEN 'text/css' ELSE 'application/xhtml+xml' END AS media_type,
        NOT sheet AS is_document, spine_pos, md5(text) AS content_md5 FROM chapters c LEFT JOIN spine s ON s.item_id = c.item_id""",
    "epub_metadata": f"WITH {_BOOKS} SELECT DISTINCT book_id, 'urn:' || book_id AS identifier, 'Title & ' || book_id || ' (fr)' AS title, 'fr' AS language, 'A <b>|' || book_id AS creators FROM chapters",
    "json_store_values": f"WITH {_JSON} SELECT {_FILE} AS file_name, md5('{{' || string_agg('\"' || pos::VARCHAR || '\": ' || to_json(translated)::VARCHAR, ', ' ORDER BY pos) || '}}') AS value_md5 FROM stored GROUP BY doc_id",
    "json_store_files": f"WITH {_JSON} SELECT 'initial' AS phase, {_FILE} AS file_name, pos::VARCHAR AS line_index, translated AS text FROM stored",
    "store_cleared": f"""WITH {_MOCK} SELECT 'initial' AS phase, doc_id::VARCHAR AS source_file, pos::VARCHAR AS line_index, CASE WHEN h % 3 = 0 THEN 'v"2 ' || original ELSE translated END AS text FROM mock WHERE h % 3 = 0 OR translated IS NOT NULL
        UNION ALL SELECT 'refined', doc_id::VARCHAR, 't' || pos::VARCHAR, original FROM mock WHERE h % 2 = 0 AND doc_id <> 4""",
    "store_lookup": f"""WITH {_MOCK} SELECT {_KEY} AS key, CASE WHEN h % 2 <> 0 OR h % 6 = 0 THEN '' ELSE 'r ' || original END AS text, h % 2 <> 0 AS missing FROM mock UNION ALL SELECT '999/x', '', true""",
    "glossary_files": f"WITH {_COUNTS} SELECT 'learned' AS kind, source, target, cnt FROM counted UNION ALL SELECT 'validated', source, target, NULL FROM validated",
    "glossary_decided": f"""WITH {_COUNTS} SELECT source, target FROM validated
        UNION ALL SELECT source, CASE length(source) % 4 WHEN 0 THEN targets[2] WHEN 1 THEN 'own ' || source ELSE targets[1] END FROM conflicts WHERE source NOT IN (SELECT source FROM validated)""",
    "glossary_override": f"WITH {_COUNTS} SELECT source, CASE WHEN source < 'M' THEN 'own ' || target ELSE target END AS target FROM validated UNION ALL SELECT 'Zzz', 'new'",
    "extraction_errors": f"""WITH {_ALIGN} SELECT pair_id, source, target, target = '' OR (lower(source) IN {_in(STOPWORDS)} AND {_UPPER.format("target")})
        OR (length(source) > 0 AND length(target) > 0 AND greatest(length(source), length(target))::DOUBLE / least(length(source), length(target)) > 5) AS is_error FROM aligned""",
    "terminology_glossary": f"WITH {_ISSUES} SELECT source, target FROM tops WHERE rn = 1",
    "all_issues": f"""WITH {_ISSUES}, {_VOTES} SELECT 'terminology' AS kind, source || ': ' || n_targets || ' targets, best ' || suggestion AS issue FROM issues
        UNION ALL SELECT 'glossary_conflicts', source || ': ' || array_to_string(targets, ', ') FROM conflicts""",
    "pair_validation": f"""WITH {_VALIDITY} SELECT k.key, coalesce(e.n, 0) AS n_untranslated, c.is_copy, coalesce(e.n, 0) = 0 AND NOT c.is_copy AS ok
        FROM keyed k JOIN copied c ON c.key = k.key LEFT JOIN english e ON e.key = k.key""",
    "chunk_sizes": f"WITH RECURSIVE {_BODY} SELECT book, chunk_id::BIGINT AS chunk_id, count(*) FILTER (WHERE role = 0) AS head, count(*) FILTER (WHERE role = 1) AS body, count(*) FILTER (WHERE role = 2) AS tail FROM members GROUP BY 1, 2",
    "segment_words": f"""WITH RECURSIVE {_LINES}, f AS (
        SELECT doc_id AS book, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seq, greatest(1, len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> ''))) AS tok FROM lines),
        folded AS (
            SELECT book, seq, tok, CASE WHEN tok > 80 THEN 1 ELSE 0 END AS chunk_id, tok AS held FROM f WHERE seq = 0
            UNION ALL SELECT f.book, f.seq, f.tok, CASE WHEN held + f.tok > 80 THEN chunk_id + 1 ELSE chunk_id END, CASE WHEN held + f.tok > 80 THEN f.tok ELSE held + f.tok END
            FROM folded JOIN f ON f.book = folded.book AND f.seq = folded.seq + 1)
        SELECT book, seq, chunk_id::BIGINT AS chunk_id, tok::BIGINT AS tok FROM folded""",
    "line_repair": f"""WITH {_REPAIR} SELECT doc_id, pos, check_name,
        CASE WHEN check_name IS NOT NULL THEN coalesce(translated, '') WHEN translated IS NULL OR q OR f THEN mended ELSE translated END AS text,
        CASE WHEN check_name IS NOT NULL THEN NULL WHEN translated IS NULL THEN CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END WHEN q THEN CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END WHEN f THEN CASE WHEN n % 3 = 0 THEN 3 ELSE 1 END ELSE 0 END AS attempts FROM judged""",
    "request_log": f"""WITH RECURSIVE {_BODY} SELECT 'llm_initial_' || book::VARCHAR || '_' || lpad(chunk_id::VARCHAR, 4, '0') || '.log' AS name, 'stand-in' AS model, 1 AS attempts,
        length(string_agg(CASE WHEN role = 1 THEN '<' || i::VARCHAR || '/>' || text ELSE text END, chr(10) || chr(10) ORDER BY role, seq)) AS prompt_len,
        md5(coalesce(string_agg('<' || i::VARCHAR || '/>' || {_upper("text")}, chr(10) ORDER BY seq) FILTER (WHERE role = 1) || chr(10), '') || '[=[END]=]') AS response_md5 FROM placed GROUP BY book, chunk_id""",
    "refine_prompts": f"""WITH RECURSIVE {_BODY}, {_COUNTS}, top AS (SELECT * FROM modes WHERE cnt::DOUBLE / total >= 0.5::DOUBLE ORDER BY total DESC, first_seen, source LIMIT 50),
        terms AS (SELECT coalesce(string_agg(source || ' → ' || target, ', ' ORDER BY total DESC, first_seen, source), '') AS terms FROM top),
        shown AS (SELECT *, (book * 31 + seq) % 17 = 0 AS lacks, CASE WHEN role = 1 THEN '<' || i::VARCHAR || '/>' ELSE '' END || CASE WHEN (book * 31 + seq) % 17 <> 0 THEN {_upper("text")} ELSE text END AS initial FROM placed)
        SELECT book, chunk_id::BIGINT AS chunk_id, bool_or(lacks) AS has_missing, md5('Refine the translation. {RULES}' || chr(10) || 'Lines: ' || count(*) FILTER (WHERE role = 1) || chr(10) || 'Glossary: ' || (SELECT CASE WHEN terms = '' THEN 'no terms' ELSE terms END FROM terms)
            || chr(10) || 'Original:' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY role, seq) || chr(10) || 'Translation:' || chr(10) || string_agg(initial, chr(10) || chr(10) ORDER BY role, seq)) AS prompt_md5 FROM shown GROUP BY book, chunk_id""",
    "stream_route": f"WITH {_QUARANTINE} SELECT m.doc_id, m.pos, coalesce(q.check_name, 'passed') AS side FROM mock m LEFT JOIN quarantined q ON q.chunk_index = m.doc_id AND q.chunk_line = m.pos",
    "two_phase_run": f"WITH RECURSIVE {_TWO} SELECT book::VARCHAR || '/' || seq::VARCHAR AS key, CASE WHEN n % 2 = 0 THEN {_strip("'r ' || initial")} ELSE initial END AS text, CASE WHEN n % 2 = 0 THEN 'refined' ELSE 'initial' END AS origin FROM firsts",
    "run_summary": f"""WITH RECURSIVE {_TWO} SELECT 'lines_' || CASE WHEN n % 2 = 0 THEN 'refined' ELSE 'initial' END AS metric, count(*)::DOUBLE AS value FROM firsts GROUP BY 1
        UNION ALL SELECT 'chunks', count(*)::DOUBLE FROM sized UNION ALL SELECT 'calls', count(*)::DOUBLE FROM sized UNION ALL SELECT 'seconds', 0.0::DOUBLE""",
}
