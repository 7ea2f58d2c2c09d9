"""SQL building blocks that repeat the adapters of ``quire.sources.corpus``."""

from quire import fixed_values as fv
from quire.sources import corpus


def lit(value: str) -> str:
    """A SQL string literal (control characters go through chr())."""
    out, run = [], ""
    for ch in value:
        if ord(ch) < 32:
            if run:
                out.append("'" + run.replace("'", "''") + "'")
                run = ""
            out.append(f"chr({ord(ch)})")
        else:
            run += ch
    if run or not out:
        out.append("'" + run.replace("'", "''") + "'")
    return out[0] if len(out) == 1 else "(" + " || ".join(out) + ")"


def lits(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


WS = lit(fv.WHITESPACE)


def strip(e: str) -> str:
    return f"trim({e}, {WS})"


def words(e: str) -> str:
    return f"regexp_extract_all({e}, '[^\\s]+')"


LN = "ln AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
PG = LN + """,
pg AS (
  SELECT doc_id, p::INTEGER AS page, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 0 AS rotation,
         array_to_string(list_slice(ls, p * 8 + 1, p * 8 + 8), chr(10)) AS text
  FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) + 7) // 8)) AS p FROM ln))"""
SP = LN + f""",
sp AS (
  SELECT doc_id, (i // 8)::INTEGER AS page, ((i % 8) // 2)::INTEGER AS block, (i % 2)::INTEGER AS line, 0 AS span,
         ls[i + 1] AS text, {lits(corpus.FONTS)}[doc_id % {len(corpus.FONTS)} + 1] AS font,
         (CASE WHEN i = 0 THEN 18 ELSE 12 END)::DOUBLE AS size,
         ((doc_id * 7919) % 16777216)::INTEGER AS color,
         CASE WHEN i = 0 THEN 16 WHEN i % 5 = 4 THEN 2 WHEN i % 7 = 3 THEN 18 WHEN i % 11 = 6 THEN 8 ELSE 4 END AS flags,
         72::DOUBLE AS x0, (72 + 14 * (i % 8))::DOUBLE AS y0, (72 + 6 * length(ls[i + 1]))::DOUBLE AS x1,
         (84 + 14 * (i % 8))::DOUBLE AS y1, 72::DOUBLE AS origin_x,
         CASE WHEN i % 3 <> 2 THEN (82 + 14 * (i % 8))::DOUBLE END AS origin_y
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM ln))"""
IM = """im AS (
  SELECT doc_id, (i % 3)::INTEGER AS page, (i // 3)::INTEGER AS idx, (i + 1)::INTEGER AS xref,
         72::DOUBLE AS x0, (100 + i * 10)::DOUBLE AS y0, (72 + 20 * length(tags[i + 1]))::DOUBLE AS x1,
         (140 + i * 10)::DOUBLE AS y1
  FROM (SELECT doc_id, tags, unnest(range(0, len(tags))) AS i FROM (
    SELECT page_id AS doc_id, regexp_extract_all(html, '<(div class=.ad.|li|b)>', 1) AS tags FROM pages)))"""
LK = """lk AS (
  SELECT doc_id, (i % 3)::INTEGER AS page, CASE WHEN starts_with(uris[i + 1], '/') THEN 1 ELSE 2 END AS kind,
         uris[i + 1] AS uri
  FROM (SELECT doc_id, uris, unnest(range(0, len(uris))) AS i FROM (
    SELECT page_id AS doc_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS uris FROM pages)))"""
MF = """mf AS (
  SELECT doc_id, 'in/' || source || '/ doc_' || doc_id || ['.PDF', '.pdf', '.txt', ' .pdf ', '.pdf'][doc_id % 5 + 1]
           AS filename, octet_length(encode(text)) + CASE WHEN doc_id % 97 = 5 THEN 60 * 1024 * 1024 ELSE 0 END AS n_bytes
  FROM documents)"""
CELLS = f"""cl AS (
  SELECT doc_id, page, 0 AS table_index, r, (c - 1)::INTEGER AS c, cells_in[c] AS cell FROM (
    SELECT doc_id, page, r, cells_in, unnest(range(1, len(cells_in) + 1)) AS c FROM (
      SELECT o_orderkey // 20 AS doc_id, ((o_orderkey // 5) % 4)::INTEGER AS page, 0 AS r,
             {lits(corpus.TABLE_HEADER)} AS cells_in
      FROM orders WHERE o_orderkey % 5 = 0
      UNION ALL
      SELECT doc_id, page, r, CASE WHEN k % 7 = 3 THEN list_slice(b, 1, 4)
             WHEN k % 11 = 5 THEN list_concat(b, ['extra']) ELSE b END FROM (
        SELECT o_orderkey AS k, o_orderkey // 20 AS doc_id, ((o_orderkey // 5) % 4)::INTEGER AS page,
               (o_orderkey % 5 + 1)::INTEGER AS r,
               [o_orderkey::VARCHAR, CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE 'c' || o_custkey END,
                CASE WHEN o_orderkey % 17 = 3 THEN 'n/a' ELSE '$' || format('{{:,.2f}}', o_totalprice) END,
                o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d')] AS b
        FROM orders WHERE (o_orderkey // 5) % 13 <> 7))))"""


def sql(parts: list[str] | str, body: str) -> str:
    if isinstance(parts, str):
        parts = [parts]
    return "WITH " + ",\n".join(parts) + "\n" + body

BL = LN + """,
bl AS (
  SELECT doc_id, (b // 4)::INTEGER AS page, (b % 4)::INTEGER AS block,
         array_to_string(list_slice(ls, b * 2 + 1, b * 2 + 2), chr(10)) AS text
  FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) + 1) // 2)) AS b FROM ln))"""
OP = f"""op AS (
  SELECT -(o_orderkey // 8 * 4 + 1) AS doc_id, (o_orderkey % 8)::INTEGER AS page,
    'Invoice dated ' || strftime(o_orderdate, '%m/%d/%Y') || ' for ' || {lits(corpus.FIRST_NAMES)}[o_custkey % 5 + 1]
    || ' ' || {lits(corpus.LAST_NAMES)}[o_custkey % 7 + 1] || ' of ' || {lits(corpus.ORGS)}[o_custkey % 6 + 1]
    || ' in The White House.' || chr(10) || 'Contact user' || o_custkey || '@shop' || (o_custkey % 50)
    || '.example.com or +1 555-010-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' now. Total $'
    || format('{{:,.2f}}', o_totalprice) || ', paid ' || strftime(o_orderdate, '%B %-d, %Y') || ' or '
    || strftime(o_orderdate, '%b %-d %y') || '.' || chr(10) || 'See https://shop.example.com/o/' || (o_orderkey % 3)
    || ' ref ' || (o_orderkey % 900 + 100) || '-45-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0')
    || ' costs 12.50 USD' AS text
  FROM orders)"""
EP = "ep AS (SELECT doc_id, page, text FROM pg UNION ALL SELECT doc_id, page, text FROM op)"


def masked(e: str) -> str:
    """Non-ASCII letters as '_', so that an ASCII word boundary acts like a Unicode one."""
    return f"regexp_replace({e}, '[^\\x00-\\x7F€£]', '_', 'g')"


def found(e: str, pattern: str) -> str:
    """All matches; patterns with word boundaries run over masked text."""
    return f"regexp_extract_all({masked(e) if chr(92) + 'b' in pattern else e}, {lit(pattern)})"


def entity_rows(pages: str, types=None) -> str:
    """(doc_id, page, entity_type, value, pos) for every match of every type."""
    out = []
    for kind, pattern in fv.ENTITY_PATTERNS.items():
        if types is not None and kind not in types:
            continue
        keep = ""
        if kind == "phones":
            keep = f" WHERE length(value) >= {fv.MIN_PHONE_CHARS}"
        if kind == "people":
            keep = f" WHERE NOT regexp_matches(value, {lit(fv.NOT_A_PERSON)})"
        out.append(
            f"SELECT doc_id, page, '{kind}' AS entity_type, value, pos FROM (SELECT doc_id, page, {strip('m[i]')} AS value,"
            f" i - 1 AS pos FROM (SELECT doc_id, page, m, unnest(range(1, len(m) + 1)) AS i FROM"
            f" (SELECT doc_id, page, {found('text', pattern)} AS m FROM {pages}))){keep}"
        )
    return "\n UNION ALL ".join(out)


def sentences(e: str, splitter: str, longer: int) -> str:
    parts = f"regexp_split_to_array(replace({e}, chr(10), ' '), '{splitter}')"
    return f"list_filter(list_transform({parts}, lambda x: {strip('x')}), lambda x: length(x) > {longer})"


def _codes():
    from quire.operators.layout import KNOWN_CODES

    return lits(KNOWN_CODES)


def glyph_cte() -> str:
    return f"""gl AS (
  SELECT ch, codes[k + 1] AS font_code, (200 + ((ascii(ch) * 7 + k * 3) % 13) * 50) / 1000.0::DOUBLE AS unit_width
  FROM (SELECT ch, codes, unnest(range(0, 12)) AS k FROM (
    SELECT DISTINCT unnest(list_distinct(string_split(text, ''))) AS ch, {_codes()} AS codes FROM documents)))"""


def width_cte(name: str, src: str, keys: str, text: str) -> str:
    """Unit width (sum over characters) of ``text`` per key of ``src``."""
    return f"""{name} AS (
  SELECT {keys}, font_code, sum(coalesce(unit_width, 0) * n) AS units FROM (
    SELECT {keys}, font_code, ch, count(*) AS n FROM (
      SELECT {keys}, font_code, unnest(string_split({text}, '')) AS ch FROM {src}) GROUP BY ALL)
  LEFT JOIN gl USING (font_code, ch) GROUP BY ALL)"""


FR = f"""fr AS (
  SELECT doc_id, page, block, line, (j - 1)::INTEGER AS span, ps[j] AS text, font, size, color, flags,
         (72 + (j - 1) * 90)::DOUBLE AS x0, (y0 + ((j - 1) % 4) * 2)::DOUBLE AS y0,
         (72 + (j - 1) * 90 + 6 * length(ps[j]))::DOUBLE AS x1, (y0 + ((j - 1) % 4) * 2 + 12)::DOUBLE AS y1
  FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM (SELECT *, string_split(text, '.') AS ps FROM sp)))"""
FP = """fp AS (
  SELECT c_custkey // 10 AS doc_id, (c_custkey % 10)::INTEGER AS page,
    'Full Name: ____ ' || c_name || chr(10) || '[x] ' || c_mktsegment || chr(10) || '[ ] Send mail' || chr(10)
    || 'Balance due:   _____ and more' || chr(10) || 'Home' || chr(10) || 'Address: ___' || chr(10) || '[X]  Nation '
    || c_nationkey || ' ' || chr(10) || 'no field: __' || chr(10) || '[y] no box' AS text
  FROM customer)"""
WI = """wi AS (
  SELECT c_custkey // 10 AS doc_id, (c_custkey % 10)::INTEGER AS page, pos::INTEGER AS pos,
         ['name', 'Send mail', 'active'][pos + 1] AS field_name, ['text', 'combobox', 'checkbox'][pos + 1] AS field_type,
         [c_name, c_mktsegment, CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'Off' END][pos + 1] AS field_value
  FROM customer, range(0, 3) AS t(pos))"""

EL = """el AS (SELECT user_id AS doc_id, event_id AS seq, ts,
  CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'edit' END AS action,
  event_type || ' ' || props AS operation FROM events)"""
MS = f"""ms AS (
  SELECT conv_id, turn, role, part, CASE part WHEN 'said' THEN text ELSE
    replace(replace(replace({lits(corpus.COMMANDS)}[(conv_id * 8 + turn) % {len(corpus.COMMANDS)} + 1], '{{1}}', w[1]),
            '{{2}}', coalesce(w[2], 'none')), '{{n}}', (turn + 2)::VARCHAR) END AS text, (turn % 3)::INTEGER AS current_page
  FROM (SELECT *, regexp_split_to_array(text, '[ \\n]') AS w FROM conversations), (VALUES ('said'), ('command')) AS t(part))"""
