"""SQL that answers the acceptance queries on its own, written from the rules rather than from the
Spark code: the clamp walks line by line, sections are cut by flags, weights come from plain joins."""

from __future__ import annotations

from quire.acceptance.queries import BASE_DATE
from quire.functions import text as X
from quire.operators.retrieval import STOP_WORDS
from quire.profiles import OUTLINE_PROFILE, SECTION_PROFILE, SECTION_CONTINUERS, Profile
from quire.sources import records

SPACES = "'" + X.WHITESPACE + "'"
WORD = X.WORD_CLASS


def strip(text: str) -> str:
    return f"trim({text}, {SPACES})"


def no_controls(text: str) -> str:
    return f"regexp_replace({text}, '[{X.CONTROL_CLASS}]', '', 'g')"


def word_count(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '[^{X.SPACE_CLASS}]+')) AS INTEGER)"


LINES = f"""
raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents
),
plain AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(pos // 40 + 1 AS INTEGER) AS page_number, CAST(pos % 40 AS INTEGER) AS line_no,
         {no_controls(strip("raw"))} AS text
  FROM raw
),
lines AS (
  SELECT *, CAST(8.0 + (length(text) % 5) * 1.5 AS DOUBLE) AS font_size, line_no * 18.0::DOUBLE AS y_position,
         line_no * 18.0::DOUBLE + CAST(8.0 + (length(text) % 5) * 1.5 AS DOUBLE) AS y_bottom,
         {word_count("text")} AS word_count, CAST(length(text) AS INTEGER) AS char_count
  FROM plain WHERE length(text) > 0
)"""

SCORED = LINES + """,
scored AS (
  SELECT *, (['Body', 'H1', 'Body', 'H2', 'Body', 'H3', 'Title'])[char_count % 7 + 1] AS level,
         CAST(0.5 + (char_count % 11) * 0.05::DOUBLE AS DOUBLE) AS confidence
  FROM lines
)"""

LOW = """confidence < CASE level WHEN 'Title' THEN 0.6::DOUBLE WHEN 'H1' THEN 0.6::DOUBLE WHEN 'H2' THEN 0.65::DOUBLE
         WHEN 'H3' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END"""
DIGITS = rf"regexp_matches(text, '^[\p{{Nd}}{X.OTHER_DIGIT_CLASS}]+$')"


def _pattern(profile: Profile) -> str:
    """The patterns with blanks and digits of any script, which RE2 takes for ASCII alone."""
    blank = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    written = [p.replace(r"\s", blank).replace(r"\d", r"\p{Nd}") for p in profile.reject_patterns]
    return "(?i)" + "|".join(f"({p})" for p in written)


DEMOTED = SCORED + f""",
demoted AS (
  SELECT * REPLACE (CASE WHEN {LOW} THEN 'Body' WHEN regexp_matches(text, '{_pattern(OUTLINE_PROFILE)}') THEN 'Body'
    WHEN word_count > 25 THEN 'Body' WHEN {DIGITS} AND length(text) < 4 THEN 'Body' ELSE level END AS level)
  FROM scored
)"""

DEMOTED_B = SCORED + f""",
demoted AS (
  SELECT * REPLACE (CASE WHEN {LOW} THEN 'Body' WHEN regexp_matches(text, '{_pattern(SECTION_PROFILE)}') THEN 'Body'
    WHEN word_count > 30 THEN 'Body' WHEN word_count < 2 AND NOT regexp_matches(text, '^\\p{{Nd}}') THEN 'Body'
    WHEN lower(text) IN ({", ".join(f"'{g}'" for g in SECTION_PROFILE.generic_names)}) THEN 'Body'
    WHEN {DIGITS} THEN 'Body' WHEN text LIKE '%.' THEN 'Body' ELSE level END AS level)
  FROM scored
)"""

CLAMPED = DEMOTED + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_number, line_no) AS n FROM demoted),
walked AS (
  SELECT doc, n, CASE WHEN level LIKE 'H%' THEN least(CAST(substr(level, 2) AS INTEGER), 1) ELSE 0 END AS seen
  FROM placed WHERE n = 1
  UNION ALL
  SELECT p.doc, p.n, CASE WHEN p.level LIKE 'H%' THEN least(CAST(substr(p.level, 2) AS INTEGER), w.seen + 1)
                          WHEN p.level = 'Title' THEN 0 ELSE w.seen END
  FROM walked w JOIN placed p ON p.doc = w.doc AND p.n = w.n + 1
),
clamped AS (
  SELECT p.* REPLACE (CASE WHEN p.level LIKE 'H%' THEN 'H' || w.seen ELSE p.level END AS level)
  FROM placed p JOIN walked w USING (doc, n)
),
flagged AS (
  SELECT *, level <> 'Body' AND coalesce(lower(text) = lag(lower(text)) OVER (PARTITION BY doc, page_number ORDER BY line_no), false)
    AS is_repeat
  FROM clamped
),
heads AS (SELECT * FROM flagged WHERE level LIKE 'H%' AND NOT is_repeat)"""

TITLES = f"""
largest AS (
  SELECT doc, arg_max(text, [font_size, -line_no]) AS largest FROM flagged WHERE page_number = 1 AND NOT {DIGITS} GROUP BY doc
),
titled AS (
  SELECT doc, arg_min(text, n) AS first FROM flagged WHERE level = 'Title' AND NOT is_repeat GROUP BY doc
),
titles AS (
  SELECT doc, coalesce(first, largest, 'Untitled Document') AS title
  FROM (SELECT DISTINCT doc FROM flagged) LEFT JOIN titled USING (doc) LEFT JOIN largest USING (doc)
)"""

OUTLINES = CLAMPED + "," + TITLES

SHOWN_OUTLINES = f"""WITH RECURSIVE {OUTLINES}
SELECT doc, title, CAST(count(level) AS INTEGER) AS n,
  coalesce(string_agg(level || '|' || page_number || '|' || text, chr(10) ORDER BY n), '') AS entries
FROM titles LEFT JOIN heads USING (doc) GROUP BY doc, title"""

SECTIONS = DEMOTED_B + f""",
marked AS (
  SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_number, line_no) AS n,
         level <> 'Body' AND NOT regexp_matches({strip("lower(text)")}, '^({"|".join(SECTION_CONTINUERS)})') AS opens
  FROM demoted
),
numbered AS (
  SELECT *, sum(CASE WHEN opens OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY n) AS section_no FROM marked
),
cut AS (
  SELECT doc, section_no, min(n) AS start FROM numbered GROUP BY doc, section_no
),
sections AS (
  SELECT doc AS document, CAST(section_no AS INTEGER) AS section_no, arg_min(text, n) AS section_title,
         arg_min(page_number, n) AS page_number,
         {strip("string_agg(text, ' ' ORDER BY n) FILTER (WHERE n > start)")} AS content
  FROM numbered JOIN cut USING (doc, section_no) GROUP BY doc, section_no
  HAVING length({strip("string_agg(text, ' ' ORDER BY n) FILTER (WHERE n > start)")}) > 0
)"""

HEADINGS = """
labelled AS (SELECT CAST(doc_id AS VARCHAR) AS doc FROM labels),
truth AS (
  SELECT doc, (page_number - 1) * 40 + line_no AS pos, level, page_number AS page,
         CASE WHEN line_no % 5 = 2 THEN left(text, length(text) // 2) || '#' || substr(text, length(text) // 2 + 2)
              WHEN line_no % 3 = 0 THEN text
              WHEN line_no % 3 = 1 THEN left(text, length(text) - 1)
              ELSE ' ' || text || ' ' END AS text
  FROM scored SEMI JOIN labelled USING (doc) WHERE level LIKE 'H%'
),
truth_titles AS (
  SELECT doc, coalesce(title, '') AS title
  FROM labelled LEFT JOIN (
    SELECT doc, arg_min(text, page_number * 100 + line_no) AS title FROM scored WHERE level = 'Title' GROUP BY doc
  ) USING (doc)
)"""

# Common subsequences of the pairs (a, b) in ``hard``, row by row of the table of prefixes: a cell is
# one more than its upper left neighbour where the characters agree, else the one above, and never
# less than those to its left.
SUBSEQUENCES = """
lcs(a, b, i, cells) AS (
  SELECT a, b, 0::BIGINT, list_transform(range(length(b)), lambda j: 0::BIGINT) FROM hard
  UNION ALL
  SELECT a, b, i, list_transform(range(1, length(b) + 1), lambda j: list_max(m[1:j])) FROM (
    SELECT a, b, i + 1 AS i, list_transform(range(1, length(b) + 1), lambda j:
      CASE WHEN substr(b, j, 1) = substr(a, i + 1, 1) THEN coalesce(cells[j - 1], 0) + 1 ELSE cells[j] END) AS m
    FROM lcs WHERE i < length(a)
  )
)"""



def _shared(side: str, a: str, b: str) -> str:
    """How many characters two texts share at one end."""
    return f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda j: {side}({a}, j) = {side}({b}, j)))"


# Pairs of a line and a heading of its page, without the ends they share. A score above 95 needs fewer
# edits than a twentieth of both lengths. If one text holds the other, or as many edits as the
# lengths differ by suffice, the shorter one is a subsequence of the longer one; the rest is hard. The edit distance here counts bytes,
# so one byte stands for any other character: that can only make it smaller.
SIMILAR = f"""
pairs AS MATERIALIZED (
  SELECT l.doc, l.page_number, l.line_no, t.pos, t.level, l.text = t.text AS same,
    CASE WHEN l.text <> t.text THEN l.text ELSE '' END AS a, CASE WHEN l.text <> t.text THEN t.text ELSE '' END AS b,
    length(l.text) + length(t.text) AS total, abs(length(l.text) - length(t.text)) AS gap
  FROM lines l JOIN truth t ON t.doc = l.doc AND t.page = l.page_number
    AND (t.text = l.text OR 20 * abs(length(l.text) - length(t.text)) < length(l.text) + length(t.text))
),
started AS MATERIALIZED (SELECT *, {_shared("left", "a", "b")} AS p FROM pairs),
cut AS MATERIALIZED (SELECT *, substr(a, p + 1) AS c, substr(b, p + 1) AS d FROM started),
ended AS MATERIALIZED (SELECT *, {_shared("right", "c", "d")} AS e FROM cut),
middles AS MATERIALIZED (SELECT * EXCLUDE (a, b, c, d), left(c, length(c) - e) AS a, left(d, length(d) - e) AS b FROM ended),
edits AS MATERIALIZED (
  SELECT *, levenshtein(regexp_replace(a, '[^\\x00-\\x7F]', '?', 'g'), regexp_replace(b, '[^\\x00-\\x7F]', '?', 'g')) AS edits
  FROM middles
),
likely AS MATERIALIZED (
  SELECT *, contains(a, b) OR contains(b, a) OR (edits = gap AND strlen(a || b) = length(a || b)) AS easy FROM edits WHERE same OR 20 * edits < total
),
hard AS MATERIALIZED (SELECT DISTINCT a, b FROM likely WHERE NOT easy),
{SUBSEQUENCES},
similar_lines AS (
  SELECT p.*, CASE WHEN same THEN 100::DOUBLE
    ELSE 200::DOUBLE * (CASE WHEN easy THEN (total - gap) // 2 ELSE p.p + p.e + coalesce(cells[length(p.b)], 0) END) / total END AS score
  FROM likely p LEFT JOIN lcs ON NOT easy AND lcs.a = p.a AND lcs.b = p.b AND lcs.i = length(p.a)
)"""

EVALUATED = OUTLINES + "," + HEADINGS + f""",
both_docs AS (SELECT doc FROM labelled INTERSECT SELECT doc FROM titles),
truth_keys AS (
  SELECT DISTINCT doc, upper(level) AS level, page, {strip("lower(text)")} AS text FROM truth SEMI JOIN both_docs USING (doc)
),
output_keys AS (
  SELECT DISTINCT doc, upper(level) AS level, page_number AS page, {strip("lower(text)")} AS text
  FROM heads SEMI JOIN both_docs USING (doc)
),
counted AS (
  SELECT doc,
    coalesce({strip("lower(tt.title)")} = {strip("lower(t.title)")}, false) AS title_correct,
    (SELECT count(*) FROM truth_keys k SEMI JOIN output_keys USING (doc, level, page, text) WHERE k.doc = b.doc) AS tp,
    (SELECT count(*) FROM output_keys k ANTI JOIN truth_keys USING (doc, level, page, text) WHERE k.doc = b.doc) AS fp,
    (SELECT count(*) FROM truth_keys k ANTI JOIN output_keys USING (doc, level, page, text) WHERE k.doc = b.doc) AS fn
  FROM both_docs b JOIN truth_titles tt USING (doc) JOIN titles t USING (doc)
)"""

# Ratcliff-Obershelp ratios of the unequal texts (a, b) of which neither is too short: the longest
# common block (first in a, then in b), and the same left and right of it, until nothing is common.
# Blocks are stretches of a diagonal, cut to the rectangle that is left. From 200 characters on, those
# of which b has more than a hundredth, and one, don't begin or prolong a block; they widen a found one,
# or the empty one at the start.
RATCLIFF = """
unlike AS MATERIALIZED (
  SELECT DISTINCT a, b FROM to_match WHERE a <> b AND 2 * least(length(a), length(b)) > 0.85 * (length(a) + length(b))
),
left_side AS (SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM unlike),
right_side AS (SELECT a, b, unnest(range(1, length(b) + 1)) AS j FROM unlike),
right_chars AS (
  SELECT *, length(b) >= 200 AND count(*) OVER (PARTITION BY a, b, c) > length(b) // 100 + 1 AS common
  FROM (SELECT *, substr(b, j, 1) AS c FROM right_side)
),
cells AS MATERIALIZED (
  SELECT l.a, l.b, l.i, l.i - r.j AS d, common FROM left_side l JOIN right_chars r ON l.a = r.a AND l.b = r.b AND substr(l.a, l.i, 1) = r.c
),
wide AS MATERIALIZED (
  SELECT a, b, d, min(i) AS i, max(i) + 1 AS e FROM (
    SELECT *, i - row_number() OVER (PARTITION BY a, b, d ORDER BY i) AS island FROM cells
  ) GROUP BY a, b, d, island
),
narrow AS MATERIALIZED (
  SELECT a, b, d, min(i) AS i, max(i) + 1 AS e FROM (
    SELECT *, i - row_number() OVER (PARTITION BY a, b, d ORDER BY i) AS island FROM cells WHERE NOT common
  ) GROUP BY a, b, d, island
),
blocks(a, b, alo, ahi, blo, bhi, i, j, e) AS (
  SELECT a, b, 1::BIGINT, length(a) + 1, 1::BIGINT, length(b) + 1, 0::BIGINT, 0::BIGINT, -1::BIGINT FROM unlike
  UNION ALL
  SELECT f.a, f.b, f.alo, f.ahi, f.blo, f.bhi, greatest(w.i, f.alo, f.blo + w.d), greatest(w.i, f.alo, f.blo + w.d) - w.d,
         least(w.e, f.ahi, f.bhi + w.d)
  FROM (
    SELECT s.a, s.b, s.alo, s.ahi, s.blo, s.bhi, coalesce(max([
      least(n.e, s.ahi, s.bhi + n.d) - greatest(n.i, s.alo, s.blo + n.d),
      -greatest(n.i, s.alo, s.blo + n.d), -(greatest(n.i, s.alo, s.blo + n.d) - n.d)
    ]), [0, -s.alo, -s.blo]) AS best
    FROM (
      SELECT a, b, alo, ahi, blo, bhi FROM blocks WHERE e = -1
      UNION ALL SELECT a, b, alo, i, blo, j FROM blocks WHERE e > 0
      UNION ALL SELECT a, b, e, ahi, j + e - i, bhi FROM blocks WHERE e > 0
    ) s LEFT JOIN narrow n ON n.a = s.a AND n.b = s.b
      AND least(n.e, s.ahi, s.bhi + n.d) > greatest(n.i, s.alo, s.blo + n.d)
    WHERE s.alo < s.ahi AND s.blo < s.bhi
    GROUP BY s.a, s.b, s.alo, s.ahi, s.blo, s.bhi
  ) f JOIN wide w ON w.a = f.a AND w.b = f.b AND w.d = f.best[3] - f.best[2] AND w.i <= -f.best[2] AND w.e > -f.best[2]
),
alike AS MATERIALIZED (
  SELECT a, b FROM (SELECT a, b, sum(e - i) AS matched FROM blocks WHERE e > 0 GROUP BY a, b)
  WHERE 2.0::DOUBLE * matched / (length(a) + length(b)) > 0.85::DOUBLE
  UNION ALL SELECT DISTINCT a, b FROM to_match WHERE a = b
)"""

FUZZY = EVALUATED + f""",
met AS (
  SELECT doc, level, page, t.text AS a, o.text AS b FROM truth_keys t JOIN output_keys o USING (doc, level, page)
),
title_pairs AS (
  SELECT doc, {strip("lower(tt.title)")} AS a, {strip("lower(t.title)")} AS b
  FROM both_docs JOIN truth_titles tt USING (doc) JOIN titles t USING (doc)
),
to_match AS MATERIALIZED (SELECT a, b FROM met UNION SELECT a, b FROM title_pairs),
{RATCLIFF},
pairs_found AS MATERIALIZED (SELECT met.* FROM met SEMI JOIN alike USING (a, b)),
found_keys AS MATERIALIZED (
  SELECT DISTINCT doc, 'truth' AS side, level, page, a AS text FROM pairs_found
  UNION ALL SELECT DISTINCT doc, 'output', level, page, b FROM pairs_found
),
all_keys AS (
  SELECT doc, 'truth' AS side, level, page, text FROM truth_keys
  UNION ALL SELECT doc, 'output', level, page, text FROM output_keys
)"""

REQUESTS = """
asked AS (
  SELECT conv_id || '-' || turn AS request_id, conv_id, role AS persona, text AS task FROM conversations
  WHERE role = 'user' AND length(text) > 0
    AND conv_id IN (SELECT doc_id % (SELECT max(conv_id) + 1 FROM conversations) FROM documents)
),
listed AS (
  SELECT request_id, CAST(doc_id AS VARCHAR) AS document
  FROM asked JOIN documents ON doc_id % (SELECT max(conv_id) + 1 FROM conversations) = conv_id
)"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
QUERIES = REQUESTS + f""",
words AS (
  SELECT request_id, unnest(w) AS word, generate_subscripts(w, 1) AS spot
  FROM (SELECT request_id, regexp_extract_all(lower(task), '[{WORD}]{{2,}}') AS w FROM asked)
),
kept AS (SELECT request_id, word, min(spot) AS spot FROM words WHERE word NOT IN ({_STOP}) GROUP BY request_id, word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY spot) AS n FROM kept),
joined AS (
  SELECT request_id, string_agg(word, ' ' ORDER BY n) AS keywords, string_agg(word, ', ' ORDER BY n) FILTER (WHERE n <= 5) AS top,
         string_agg(word, ' ' ORDER BY n) FILTER (WHERE n <= 10) AS requirements
  FROM ranked GROUP BY request_id
),
queries AS (
  SELECT request_id, coalesce(keywords, '') AS keywords, coalesce(requirements, '') AS requirements,
    'As a ' || persona || ', I need to ' || task || '. Focus on sections that address: ' || coalesce(top, '')
    || '. Provide practical, actionable information relevant to this specific task.' AS query
  FROM asked LEFT JOIN joined USING (request_id)
)"""


def _grams(name: str, source: str, key: str, text: str) -> str:
    """Counts of one- and two-word terms."""
    return f"""
{name}_words AS (
  SELECT {key}, unnest(w) AS word, generate_subscripts(w, 1) AS spot
  FROM (SELECT {key}, regexp_extract_all(lower({text}), '[{WORD}]{{2,}}') AS w FROM {source})
),
{name} AS (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, word AS term FROM {name}_words
    UNION ALL
    SELECT {key}, word || ' ' || lead(word) OVER (PARTITION BY {key} ORDER BY spot) FROM {name}_words
  ) WHERE term IS NOT NULL GROUP BY {key}, term
)"""


def _tfidf(section_text: str, query: str) -> str:
    key = "document, section_no"
    return (
        SECTIONS + "," + QUERIES + "," + _grams("held", "sections", key, section_text) + ","
        + _grams("wanted", "queries", "request_id", query) + f""",
corpus AS (SELECT count(*)::DOUBLE AS n FROM sections),
vocabulary AS (
  SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (
    SELECT term, count(*) AS df, sum(tf) AS total FROM held GROUP BY term
  ), corpus
),
held_w AS (
  SELECT {key}, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {key})) AS w FROM held JOIN vocabulary USING (term)
),
wanted_w AS (
  SELECT request_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY request_id)) AS w
  FROM wanted JOIN vocabulary USING (term)
),
pairs AS (SELECT request_id, document, section_no FROM listed JOIN sections USING (document)),
common AS (
  SELECT request_id, document, section_no, sum(h.w * q.w) AS dot
  FROM wanted_w q JOIN listed USING (request_id) JOIN held_w h USING (document, term)
  GROUP BY request_id, document, section_no
),
scores AS (SELECT request_id, document, section_no, coalesce(dot, 0) AS score FROM pairs LEFT JOIN common USING (request_id, document, section_no))
"""
    )


def _bm25(pairs: str) -> str:
    """BM25 of the pairs named; needs sections, queries."""
    text = _WHOLE
    return f"""
section_words AS (SELECT document, section_no, regexp_extract_all(lower({text}), '[{WORD}]{{2,}}') AS w FROM sections),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM section_words),
tf AS (
  SELECT document, section_no, len, word, count(*) AS tf
  FROM (SELECT document, section_no, len(w) AS len, unnest(w) AS word FROM section_words) GROUP BY ALL
),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
query_words AS (
  SELECT DISTINCT request_id, unnest(regexp_extract_all(lower(query), '[{WORD}]{{2,}}')) AS word FROM queries
),
gains AS (
  SELECT request_id, document, section_no,
    sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean))) AS gain
  FROM {pairs} JOIN query_words USING (request_id) JOIN tf USING (document, section_no, word) JOIN df USING (word), stats
  GROUP BY request_id, document, section_no
),
relevances AS (
  SELECT p.*, coalesce(gain, 0) AS relevance FROM {pairs} p LEFT JOIN gains USING (request_id, document, section_no)
)"""


_WHOLE = "'Title: ' || section_title || '. Content: ' || content"


def _best(score: str, partition: str = "request_id") -> str:
    return f"CAST(row_number() OVER (PARTITION BY {partition} ORDER BY round({score}, 9) DESC, document, section_no) AS INTEGER)"


_CHOSEN = _tfidf(_WHOLE, "query") + f""",
candidates AS (SELECT * FROM (SELECT *, {_best("score")} AS rank FROM scores) WHERE rank <= 30),
{_bm25("candidates")},
blended AS (SELECT *, 0.8::DOUBLE * relevance + 0.2::DOUBLE * score AS final_score FROM relevances),
few AS (SELECT * FROM (SELECT *, {_best("final_score", "request_id, document")} AS k FROM blended) WHERE k <= 2),
chosen AS (SELECT * FROM (SELECT *, {_best("final_score")} AS importance_rank FROM few) WHERE importance_rank <= 5)"""

VECTORS = """
asked AS (
  SELECT CAST(label AS VARCHAR) AS request_id, list(x ORDER BY spot) AS v FROM (
    SELECT label, spot, avg(x::DOUBLE) AS x FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS spot FROM embeddings
    ) GROUP BY label, spot
  ) GROUP BY label
),
listed AS (
  SELECT CAST(label AS VARCHAR) AS request_id, CAST((label + i) % (SELECT max(label) + 1 FROM embeddings) AS VARCHAR) AS document
  FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest([0, 1, 2]) AS i)
),
scores AS (
  SELECT request_id, document, CAST(vec_id AS INTEGER) AS section_no, list_cosine_similarity(v, embedding::DOUBLE[]) AS score
  FROM asked JOIN listed USING (request_id) JOIN embeddings ON CAST(label AS VARCHAR) = document
)"""


def _values(rows: list, columns: str) -> str:
    def literal(value) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)
    listed = ", ".join(
        f"({i}, " + ", ".join(literal(v) for v in (row if isinstance(row, tuple) else (row,))) + ")" for i, row in enumerate(rows)
    )
    return f"(VALUES {listed}) AS t({columns})"


def _drawn(salt: str, size: int) -> str:
    return f"(('0x' || substr(md5('42:' || c_custkey || ':{salt}'), 1, 8))::BIGINT % {size})"


_HTML_TAGS = (
    "address|article|aside|blockquote|body|caption|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "h1|h2|h3|h4|h5|h6|head|header|hr|html|legend|li|main|menu|nav|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|"
    "thead|title|tr|ul"
)
_HTML_TEXT = r"regexp_replace(line.inside, '<[^>]*>', ' ', 'g')"
for _name, _char in (
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("copy", "©"), ("reg", "®"), ("middot", "·"), ("amp", "&"),
):
    _HTML_TEXT = f"replace({_HTML_TEXT}, '&{_name};', '{_char}')"

_HASHED = "md5('42:' || doc_id)"

ORACLES = {
    "line_features": f"""WITH {LINES}
SELECT doc, page_number, line_no, text, word_count, char_count,
  CAST(regexp_matches(text, '\\p{{Lu}}') AND NOT regexp_matches(text, '[\\p{{Ll}}\\p{{Lt}}]') AND length(text) > 1 AS INTEGER) AS is_all_caps,
  CAST(regexp_matches(text, '^[{X.SPACE_CLASS}]*\\p{{Nd}}+(\\.\\p{{Nd}}+)*($|[^{WORD}])') AS INTEGER) AS starts_with_number
FROM lines""",
    "layout_features": f"""WITH {LINES},
quartiles AS (
  SELECT doc, page_number, quantile_cont(font_size, 0.25) AS q25, quantile_cont(font_size, 0.75) AS q75
  FROM lines WHERE font_size > 4 GROUP BY doc, page_number
),
sizes AS (
  SELECT doc, page_number, font_size, count(*) AS n, min(line_no) AS first, font_size BETWEEN any_value(q25) AND any_value(q75) AS inside
  FROM lines JOIN quartiles USING (doc, page_number) GROUP BY doc, page_number, font_size
),
body AS (
  SELECT doc, page_number, coalesce(arg_max(font_size, [n, -first]) FILTER (WHERE inside), arg_max(font_size, [n, -first])) AS body_size
  FROM sizes GROUP BY doc, page_number
),
near AS (
  SELECT *, lag(font_size) OVER w AS size_before, lag(y_bottom) OVER w AS bottom_before,
         lead(font_size) OVER w AS size_after, lead(y_position) OVER w AS top_after
  FROM lines WINDOW w AS (PARTITION BY doc, page_number ORDER BY line_no)
)
SELECT doc, page_number, line_no, body_size, round_even(font_size / body_size, 3) AS relative_font_size, word_count,
  CAST(y_position - coalesce(bottom_before, 0) > 1.5::DOUBLE * coalesce(size_before, font_size) AS INTEGER) AS is_prev_line_blank,
  CAST(coalesce(top_after, 792.0::DOUBLE) - y_bottom > 1.5::DOUBLE * font_size AS INTEGER) AS is_next_line_blank,
  font_size - coalesce(size_before, font_size) AS font_size_diff_prev,
  font_size - coalesce(size_after, font_size) AS font_size_diff_next
FROM near JOIN body USING (doc, page_number)""",
    "page_tree_lines": f"""WITH {LINES},
spans AS (
  SELECT doc, page_number, line_no, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS spot
  FROM lines
),
sized AS (
  SELECT doc, page_number, line_no, 8.0::DOUBLE + (length(word) % 3) * 1.5::DOUBLE AS size, count(*) AS n, min(spot) AS first
  FROM spans GROUP BY ALL
),
fonts AS (
  SELECT doc, page_number, line_no, CASE WHEN length(word) % 2 = 0 THEN 'Times-Bold' ELSE 'Times' END AS font, count(*) AS n, min(spot) AS first
  FROM spans GROUP BY ALL
),
one_size AS (SELECT doc, page_number, line_no, arg_max(size, [n, -first]) AS font_size FROM sized GROUP BY ALL),
one_font AS (SELECT doc, page_number, line_no, arg_max(font, [n, -first]) AS font_name FROM fonts GROUP BY ALL),
bold AS (
  SELECT doc, page_number, line_no, CAST(bool_or(length(word) % 2 = 0 OR length(word) % 5 = 0) AS INTEGER) AS is_bold FROM spans GROUP BY ALL
)
SELECT doc, page_number, CAST(row_number() OVER (PARTITION BY doc, page_number ORDER BY line_no) - 1 AS INTEGER) AS line_no,
  {no_controls(strip("text"))} AS text, o.font_size, font_name, is_bold, 0.0::DOUBLE AS x_position, y_position
FROM lines JOIN one_size o USING (doc, page_number, line_no) JOIN one_font USING (doc, page_number, line_no) JOIN bold USING (doc, page_number, line_no)""",
    "span_rows": f"""WITH {LINES},
spans AS (
  SELECT unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS spot FROM lines
),
rows AS (
  SELECT CAST(round_even(8.0::DOUBLE + (length(word) % 3) * 1.5::DOUBLE, 0) AS INTEGER) AS font_size,
    CASE WHEN length(word) % 2 = 0 THEN 'Times-Bold' ELSE 'Times' END AS font_name, CAST(length(word) % 2 = 0 AS INTEGER) AS is_bold,
    CAST(round_even(spot * 7.5::DOUBLE, 0) AS INTEGER) AS x_position, {strip("word")} AS text
  FROM spans
)
SELECT font_size, font_name, is_bold, x_position, {word_count("text")} AS word_count, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars
FROM rows WHERE length(text) > 0 GROUP BY ALL""",
    "page_counts": """WITH pages_of AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc, (len(string_split(text, chr(10))) - 1) // 40 + 1 AS pages FROM documents
) SELECT doc, CAST(pages AS BIGINT) AS pages FROM pages_of""",
    "html_lines": f"""WITH cleaned AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '[\\x01-\\x03]', '', 'g') AS h
  FROM pages
),
marked AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?i)<br\\s*/?>', chr(3), 'g'),
    '(?i)<({_HTML_TAGS})(\\s[^>]*)?/?>', chr(1) || '\\1' || chr(2), 'g'), '(?i)</({_HTML_TAGS})\\s*>', chr(1) || 'body' || chr(2), 'g') AS h
  FROM cleaned
),
pieces AS (
  SELECT page_id, unnest(string_split(h, chr(1))) AS piece, generate_subscripts(string_split(h, chr(1)), 1) AS spot FROM marked
),
parts AS (
  SELECT page_id, spot, CASE WHEN contains(piece, chr(2)) THEN lower(split_part(piece, chr(2), 1)) ELSE 'body' END AS tag,
    string_split(CASE WHEN contains(piece, chr(2)) THEN substr(piece, strpos(piece, chr(2)) + 1) ELSE piece END, chr(3)) AS insides
  FROM pieces
),
line AS (
  SELECT page_id, spot, tag, unnest(insides) AS inside, generate_subscripts(insides, 1) AS below FROM parts
),
texts AS (SELECT *, {strip(f"regexp_replace({_HTML_TEXT}, '[{X.SPACE_CLASS}]+', ' ', 'g')")} AS text FROM line)
SELECT CAST(page_id AS VARCHAR) AS doc, 1 AS page_number,
  CAST(row_number() OVER (PARTITION BY page_id ORDER BY spot, below) - 1 AS INTEGER) AS line_no, tag, text,
  CASE tag WHEN 'title' THEN 30.0::DOUBLE WHEN 'h1' THEN 24.0::DOUBLE WHEN 'h2' THEN 20.0::DOUBLE WHEN 'h3' THEN 16.0::DOUBLE
    WHEN 'h4' THEN 14.0::DOUBLE WHEN 'h5' THEN 13.0::DOUBLE WHEN 'h6' THEN 12.5::DOUBLE ELSE 12.0::DOUBLE END AS font_size,
  CAST(regexp_matches(inside, '(?i)<(b|strong)(\\s[^>]*)?>') OR tag IN ('title', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6') AS INTEGER) AS is_bold
FROM texts WHERE length(text) > 0""",
    "page_quantiles": f"""WITH {LINES}
SELECT doc, page_number, round(quantile_cont(font_size, 0.25), 6) AS q25, round(quantile_cont(font_size, 0.75), 6) AS q75
FROM lines WHERE font_size > 4 GROUP BY doc, page_number""",
    "rule_demote_a": f"WITH {DEMOTED} SELECT doc, page_number, line_no, level FROM demoted",
    "rule_demote_b": f"WITH {DEMOTED_B} SELECT doc, page_number, line_no, level FROM demoted",
    "level_clamp": f"WITH RECURSIVE {CLAMPED} SELECT doc, page_number, line_no, level FROM clamped",
    "adjacent_dedupe": f"""WITH {SCORED},
near AS (
  SELECT *, lag(lower(text)) OVER (PARTITION BY doc ORDER BY page_number, line_no) AS text_before,
         lag(page_number) OVER (PARTITION BY doc ORDER BY page_number, line_no) AS page_before
  FROM scored
)
SELECT doc, page_number, line_no, level FROM near
WHERE NOT (level <> 'Body' AND coalesce(lower(text) = text_before AND page_number = page_before, false))""",
    "document_titles": f"WITH RECURSIVE {OUTLINES} SELECT doc, title FROM titles",
    "outline_headings": f"WITH RECURSIVE {CLAMPED} SELECT doc, page_number, line_no, level, text FROM heads",
    "outlines": SHOWN_OUTLINES,
    "outline_stream": SHOWN_OUTLINES,
    "outline_document_files": SHOWN_OUTLINES,
    "fallback_outlines": f"""WITH {LINES},
largest AS (
  SELECT doc, arg_max(text, [font_size, -line_no]) AS largest FROM lines WHERE page_number = 1 AND NOT {DIGITS} GROUP BY doc
)
SELECT doc, coalesce(largest, 'Untitled Document') AS title, 0 AS n, '' AS entries
FROM (SELECT DISTINCT doc FROM lines) LEFT JOIN largest USING (doc)""",
    "corpus_listing": "SELECT 'doc ' || doc_id || '.v1' AS name, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents",
    "request_reader": """
SELECT conv_id || '-' || turn AS request_id, CASE WHEN good THEN CASE WHEN turn % 3 <> 0 THEN role ELSE 'User' END END AS persona,
  CASE WHEN good THEN text END AS task, CASE WHEN good THEN conv_id || '-' || turn END AS first_document,
  CASE WHEN good THEN 'read' WHEN turn % 7 = 6 THEN 'unreadable' ELSE 'no task' END AS verdict
FROM (SELECT *, turn % 7 <> 6 AND turn % 5 <> 4 AND coalesce(length(text) > 0, false) AS good FROM conversations)""",
    "labelled_csv": f"""
SELECT CAST(doc_id AS INTEGER) AS page_number, coalesce(CASE WHEN doc_id % 7 <> 0 THEN ' "a", ' || text || chr(10) || chr(10) || ' b' || chr(9) END, '') AS text,
  coalesce(CASE WHEN doc_id % 5 <> 0 THEN source END, '') AS font_name, CAST(8.0 + (length(text) % 5) * 1.5 AS DOUBLE) AS font_size,
  {word_count("text")} AS word_count, CAST(length(text) AS INTEGER) AS char_count, 0 AS is_bold, 'q' || quality || 't' || toxic AS label
FROM documents JOIN labels USING (doc_id)""",
    "outline_objects": f"""WITH RECURSIVE {OUTLINES}
SELECT doc, CAST(to_json({{'title': title, 'outline':
  coalesce(list({{'level': level, 'text': text, 'page': page_number}} ORDER BY n) FILTER (WHERE level IS NOT NULL), [])}}) AS VARCHAR) AS json
FROM titles LEFT JOIN heads USING (doc) GROUP BY doc, title""",
    "sections": f"WITH {SECTIONS} SELECT * FROM sections",
    "label_lines": f"""WITH RECURSIVE {SCORED}, {HEADINGS}, {SIMILAR},
best AS (
  SELECT doc, page_number, line_no, level, row_number() OVER (PARTITION BY doc, page_number, line_no ORDER BY score DESC, pos) AS k
  FROM similar_lines WHERE score > 95
)
SELECT doc, page_number, line_no, text, coalesce(level, 'Body') AS label
FROM (SELECT doc, page_number, line_no, text FROM lines) LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (doc, page_number, line_no)""",
    "label_lines_exact": f"""WITH {SCORED}, {HEADINGS}
SELECT l.doc, l.page_number, l.line_no, coalesce(arg_min(t.level, t.pos), 'Body') AS label
FROM lines l LEFT JOIN truth t ON t.doc = l.doc AND t.page = l.page_number AND t.text = l.text
GROUP BY l.doc, l.page_number, l.line_no""",
    "label_counts": f"""WITH {SCORED}, {HEADINGS}
SELECT level, count(*) AS n FROM (
  SELECT upper(level) AS level FROM truth UNION ALL SELECT 'Title' FROM truth_titles WHERE length(title) > 0
) GROUP BY level""",
    "value_share": """SELECT quality, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 3) AS share
FROM labels GROUP BY quality""",
    "balance_body": f"""WITH hashed AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_HASHED}) AS n FROM labels)
SELECT doc_id, quality, toxic FROM hashed
WHERE quality <> 1 OR n <= least((SELECT count(*) FROM labels WHERE quality = 1), (SELECT count(*) FROM labels WHERE quality <> 1))""",
    "stratified_split": f"""SELECT doc_id, quality, toxic,
  row_number() OVER (PARTITION BY quality ORDER BY {_HASHED}) <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY quality)) AS is_test
FROM labels""",
    "eval_documents_exact": f"WITH RECURSIVE {EVALUATED} SELECT doc, title_correct, tp, fp, fn FROM counted",
    "eval_metrics": f"""WITH RECURSIVE {EVALUATED},
sums AS (
  SELECT count(*) AS documents, count(*) FILTER (WHERE title_correct) AS titles_correct, CAST(sum(tp) AS BIGINT) AS tp,
         CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
  FROM counted
),
scored_sums AS (
  SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM sums
)
SELECT documents, titles_correct, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall,
  round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(titles_correct::DOUBLE / nullif(documents, 0), 6) AS title_accuracy
FROM scored_sums""",
    "eval_missed": f"""WITH RECURSIVE {EVALUATED}
SELECT doc, 'truth' AS side, level, page, text FROM truth_keys ANTI JOIN output_keys USING (doc, level, page, text)
UNION ALL
SELECT doc, 'output' AS side, level, page, text FROM output_keys ANTI JOIN truth_keys USING (doc, level, page, text)""",
    "eval_documents": f"""WITH RECURSIVE {FUZZY},
sums AS (
  SELECT doc, count(*) FILTER (side = 'truth') AS n_truth, count(*) FILTER (side = 'output') AS n_output FROM all_keys GROUP BY doc
),
hits AS (
  SELECT doc, count(*) FILTER (side = 'truth') AS n_truth, count(*) FILTER (side = 'output') AS n_output FROM found_keys GROUP BY doc
)
SELECT doc, s.a IS NOT NULL AS title_correct, coalesce(hits.n_truth, 0) AS tp,
  coalesce(sums.n_output, 0) - coalesce(hits.n_output, 0) AS fp, coalesce(sums.n_truth, 0) - coalesce(hits.n_truth, 0) AS fn
FROM title_pairs p LEFT JOIN alike s USING (a, b) LEFT JOIN sums USING (doc) LEFT JOIN hits USING (doc)""",
    "eval_missed_fuzzy": f"""WITH RECURSIVE {FUZZY}
SELECT doc, side, level, page, text FROM all_keys ANTI JOIN found_keys USING (doc, side, level, page, text)""",
    "confusion": """WITH classes AS (SELECT quality AS c FROM labels UNION SELECT toxic FROM labels),
cells AS (
  SELECT t.c AS label, p.c AS predicted, count(quality) AS n
  FROM classes t CROSS JOIN classes p LEFT JOIN labels ON quality = t.c AND toxic = p.c
  GROUP BY t.c, p.c
)
SELECT label, predicted, n, coalesce(round(n / nullif(sum(n) OVER (PARTITION BY label), 0)::DOUBLE, 6), 0) AS share FROM cells""",
    "class_report": """WITH classes AS (SELECT quality AS c FROM labels UNION SELECT toxic FROM labels),
counts AS (
  SELECT c, (SELECT count(*) FROM labels WHERE quality = c AND toxic = c)::DOUBLE AS hit,
    (SELECT count(*) FROM labels WHERE quality = c) AS support, (SELECT count(*) FROM labels WHERE toxic = c) AS chosen
  FROM classes
),
scores AS (
  SELECT CAST(c AS VARCHAR) AS class, coalesce(hit / nullif(chosen, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r, support, hit
  FROM counts
),
full_scores AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM scores)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
  SELECT class, p, r, f, support FROM full_scores
  UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM full_scores
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM full_scores
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM full_scores
)""",
    "manifest_found": f"""WITH {REQUESTS}
SELECT document, request_id FROM listed WHERE document IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    "manifest_missing": f"""WITH {REQUESTS}
SELECT document, request_id FROM listed WHERE document NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    "request_queries": f"WITH {QUERIES} SELECT request_id, keywords, query, requirements FROM queries",
    "retrieval_texts": f"""WITH {SECTIONS}
SELECT document, section_no, section_title || '. ' || left(content, 200) AS requirement_text,
  'Title: ' || section_title || '. Content: ' || left(content, 500) AS retrieval_text
FROM sections""",
    "cosine_topk": f"""WITH {VECTORS}
SELECT * FROM (SELECT request_id, document, section_no, {_best("score")} AS rank, round(score, 6) AS score FROM scores) WHERE rank <= 30""",
    "diverse_topk": f"""WITH {VECTORS},
best AS (SELECT * FROM (SELECT *, {_best("score")} AS rank FROM scores) WHERE rank <= 30),
few AS (SELECT * FROM (SELECT *, {_best("score", "request_id, document")} AS k FROM best) WHERE k <= 2)
SELECT * FROM (
  SELECT request_id, document, section_no, {_best("score")} AS importance_rank, round(score, 6) AS score FROM few
) WHERE importance_rank <= 5""",
    "tfidf_rank": f"""WITH {_tfidf(_WHOLE, "query")}
SELECT * FROM (SELECT request_id, document, section_no, {_best("score")} AS rank, round(score, 6) AS score FROM scores) WHERE rank <= 30""",
    "requirement_scores": f"""WITH {_tfidf("section_title || '. ' || content", "requirements")}
SELECT request_id, document, section_no, round(score, 6) AS semantic_score FROM scores""",
    "bm25_rank": f"""WITH {SECTIONS}, {QUERIES},
pairs AS (SELECT request_id, document, section_no FROM listed JOIN sections USING (document)),
{_bm25("pairs")}
SELECT * FROM (
  SELECT request_id, document, section_no, {_best("relevance")} AS rank, round(relevance, 6) AS relevance FROM relevances
) WHERE rank <= 30""",
    "blend_rank": f"""WITH {_CHOSEN}
SELECT request_id, document, section_no, importance_rank, round(final_score, 6) AS final_score FROM chosen""",
    "ranked_results": f"""WITH {_CHOSEN},
inputs AS (SELECT request_id, string_agg(document, ',' ORDER BY document) AS input_documents FROM listed GROUP BY request_id)
SELECT request_id, any_value(input_documents) AS input_documents, any_value(persona) AS persona, any_value(task) AS job_to_be_done,
  '{BASE_DATE}T10:15:00.000000' AS processing_timestamp,
  string_agg(importance_rank || '|' || document || '|' || page_number || '|' || section_title, chr(10) ORDER BY importance_rank) AS extracted_sections,
  string_agg(content, chr(10) ORDER BY importance_rank) AS refined_texts
FROM chosen JOIN sections USING (document, section_no) JOIN asked USING (request_id) JOIN inputs USING (request_id)
GROUP BY request_id""",
    "class_weights": """WITH rows AS (
  SELECT 'q' || quality || 't' || toxic AS label FROM labels JOIN documents USING (doc_id)
),
counts AS (SELECT label, count(*) AS n FROM rows GROUP BY label)
SELECT label, round((SELECT sum(n) FROM counts)::DOUBLE / ((SELECT count(*) FROM counts) * n), 6) AS weight, n FROM counts""",
    "label_index": """WITH rows AS (
  SELECT doc_id, 'q' || quality || 't' || toxic AS label FROM labels JOIN documents USING (doc_id)
)
SELECT doc_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS index FROM rows""",
    "imputed_features": """WITH rows AS (
  SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN CAST(8.0 + (length(text) % 5) * 1.5 AS DOUBLE) END AS font_size,
    CASE WHEN doc_id % 5 <> 0 THEN (doc_id * 37 % 1000) / 4::DOUBLE END AS x_position,
    """ + word_count("text") + """::DOUBLE AS word_count,
    CASE WHEN doc_id % 3 <> 0 THEN length(text)::DOUBLE END AS char_count
  FROM labels JOIN documents USING (doc_id)
),
middle AS (SELECT median(font_size) AS f, median(x_position) AS x, median(word_count) AS w, median(char_count) AS c FROM rows)
SELECT doc_id, coalesce(font_size, f) AS font_size, coalesce(x_position, x) AS x_position,
  coalesce(word_count, w) AS word_count, coalesce(char_count, c) AS char_count FROM rows, middle""",
    "font_one_hot": """WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS font FROM labels JOIN documents USING (doc_id)
),
fonts AS (SELECT font, CAST(row_number() OVER (ORDER BY count(*) DESC, font) - 1 AS INTEGER) AS slot FROM rows GROUP BY font)
SELECT doc_id, slot, 1::INTEGER AS n_set, 1::DOUBLE AS value FROM rows JOIN fonts USING (font)""",
    "text_features_tfidf": f"""WITH rows AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[{WORD}]{{2,}}') AS w FROM labels JOIN documents USING (doc_id)
),
grams AS (
  SELECT doc_id, unnest(w) AS term FROM rows UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM rows
),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
found AS (SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY term),
size AS (SELECT count(*)::DOUBLE AS n FROM rows),
terms AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS slot, idf FROM (
    SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM found, size WHERE df >= 2 AND df <= 0.95 * n
    ORDER BY total DESC, term LIMIT 30000
  )
),
weights AS (
  SELECT term, slot, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS w FROM counts JOIN terms USING (term)
)
SELECT term, slot, count(*) AS n_rows, round(sum(w), 5) AS weight FROM weights GROUP BY term, slot""",
    "train_holdout": """WITH rows AS (
  SELECT doc_id, 'q' || quality || 't' || toxic AS label, md5('42:' || doc_id) AS hash FROM labels JOIN documents USING (doc_id)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY hash) AS rank, count(*) OVER (PARTITION BY label) AS n FROM rows
)
SELECT doc_id, label, rank <= floor(0.2 * n + 0.5) AS is_test FROM ranked""",
    "argmax_class": """SELECT vec_id, printf('c%04d', list_position(s, list_max(s)) - 1) AS level, round(list_max(s), 6) AS confidence
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS s FROM embeddings)""",
    "synth_records": f"""WITH drawn AS (
  SELECT c_custkey, {_drawn("venue", len(records.VENUES))} AS venue, {_drawn("contact", len(records.CONTACTS))} AS contact,
    {_drawn("name", len(records.FIRST_NAMES))} AS name, {_drawn("reason", len(records.REASONS))} AS reason,
    DATE '{BASE_DATE}' + CAST({_drawn("day", 77)} + 14 AS INTEGER) AS day,
    {_drawn("hour", 10)} + 10 AS hour, {_drawn("minute", 4)} * 15 AS minute
  FROM customer
),
venues AS (SELECT * FROM {_values(records.VENUES, "venue, venue_name, address_l1, address_l2")}),
contacts AS (SELECT * FROM {_values(records.CONTACTS, "contact, who, phone")}),
names AS (SELECT * FROM {_values(records.FIRST_NAMES, "name, first_name")}),
reasons AS (SELECT * FROM {_values(records.REASONS, "reason, why")})
SELECT c_custkey AS id, venue_name, first_name || '''s ' || why || ' Party' AS for_person,
  strftime(day, '%A, %B %d, %Y') AS date, strftime(make_timestamp(2025, 1, 1, hour, minute, 0.0), '%I:%M %p') AS time,
  address_l1, address_l2,
  'by ' || strftime(DATE '{BASE_DATE}' + 7, '%B %d') || ' to ' || who || ' at ' || phone AS rsvp
FROM drawn JOIN venues USING (venue) JOIN contacts USING (contact) JOIN names USING (name) JOIN reasons USING (reason)""",
}


def _columns(query: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({ORACLES[query]})"


ORACLES["body_size"] = f"SELECT DISTINCT doc, page_number, body_size FROM ({ORACLES['layout_features']})"
ORACLES["relative_size"] = _columns("layout_features", "doc, page_number, line_no, body_size, relative_font_size")
ORACLES["neighbor_gaps"] = _columns(
    "layout_features",
    "doc, page_number, line_no, font_size_diff_prev, is_prev_line_blank, font_size_diff_next, is_next_line_blank",
)
