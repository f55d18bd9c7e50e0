"""SQL that does, by recursion in DuckDB, what the operators do; for comparison only."""

from __future__ import annotations

from ..functions.pretokenize import WHITE_SPACE
from ..sources.model import BPE, BYTE, META, UNUSED, Model, byte_value


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(text(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in r) + ")" for r in rows)


WORDS = f"list_transform(list_filter(regexp_split_to_array({{text}}, '[{WHITE_SPACE}]+'), lambda x: x <> ''), lambda x: '{META}' || x)"
METASPACE = f"regexp_extract_all(CASE WHEN {{text}} = '' OR starts_with(replace({{text}}, ' ', '{META}'), '{META}') THEN replace({{text}}, ' ', '{META}') ELSE '{META}' || replace({{text}}, ' ', '{META}') END, '{META}[^{META}]*')"


def vocab_rows(model: Model) -> str:
    return values([(p, i, float(model.scores[i]), int(model.types[i])) for i, p in enumerate(model.pieces)])


def segment_ctes(source: str, cut: str) -> str:
    """seg(k, sp, w) of a source that gives k and text."""
    return f"""src AS ({source}),
seg AS (SELECT k, generate_subscripts(s, 1) AS sp, unnest(s) AS w FROM (SELECT k, {cut.format(text='text')} AS s FROM src)),
words AS (SELECT DISTINCT w FROM seg)"""


def unigram_ctes(model: Model) -> str:
    """enc(w, out, pieces) of words(w): Viterbi in float32, one character at a time, the longest last piece of equals."""
    rows = values([(p, i, float(model.scores[i])) for p, i in model.matchable.items()])
    unknown = f"CAST({model.score_bounds[0] - 10} AS FLOAT)"
    if model.byte_fallback:
        unknown = "CAST(-4 * octet_length(encode(substr(f.w, f.e + 1, 1))) AS FLOAT)"
    return f"""vocab(piece, id, score) AS (SELECT column0, column1, CAST(column2 AS FLOAT) FROM (VALUES {rows}) AS t(column0, column1, column2)),
lens AS (SELECT unnest(range(1, {model.longest + 1})) AS n),
fwd AS (
  SELECT w, 0 AS e, [CAST(0 AS FLOAT)] AS sc, [CAST(0 AS BIGINT)] AS ln, [CAST(0 AS BIGINT)] AS ids FROM words
  UNION ALL
  SELECT w, e + 1, list_append(any_value(sc), max(c).s), list_append(any_value(ln), max(c).n), list_append(any_value(ids), max(c).i)
  FROM (SELECT f.w, f.e, f.sc, f.ln, f.ids, {{'s': CAST(f.sc[f.e + 2 - l.n] + coalesce(v.score, {unknown}) AS FLOAT), 'n': CAST(l.n AS BIGINT), 'i': CAST(coalesce(v.id, {model.unk_id}) AS BIGINT)}} AS c
        FROM fwd f JOIN lens l ON l.n <= f.e + 1 LEFT JOIN vocab v ON v.piece = substr(f.w, f.e + 2 - l.n, l.n)
        WHERE f.e < length(f.w) AND (v.id IS NOT NULL OR l.n = 1))
  GROUP BY w, e),
back AS (
  SELECT w, CAST(e AS BIGINT) AS p, ln, ids, CAST([] AS BIGINT[]) AS out, CAST([] AS VARCHAR[]) AS pieces FROM fwd WHERE e = length(w)
  UNION ALL
  SELECT w, p - ln[p + 1], ln, ids, list_prepend(ids[p + 1], out), list_prepend(substr(w, p - ln[p + 1] + 1, ln[p + 1]), pieces) FROM back WHERE p > 0),
enc AS (SELECT w, out, pieces FROM back WHERE p = 0)"""


def bpe_ctes(model: Model) -> str:
    """enc(w, out, pieces) of words(w): the best pair merges, then the leftmost, until none is left."""
    rows = values([(p, i, float(model.scores[i])) for p, i in model.index.items()])
    return f"""vocab(piece, id, score) AS (SELECT column0, column1, CAST(column2 AS FLOAT) FROM (VALUES {rows}) AS t(column0, column1, column2)),
merged AS (
  SELECT w, string_split(w, '') AS sy, 0 AS step FROM words
  UNION ALL
  SELECT w, list_concat(list_concat(sy[1 : i - 1], [sy[i] || sy[i + 1]]), sy[i + 2 : len(sy)]), step + 1
  FROM (SELECT w, any_value(sy) AS sy, step, -max({{'s': v.score, 'n': -i}}).n AS i
        FROM (SELECT w, sy, step, unnest(range(1, len(sy))) AS i FROM merged WHERE len(sy) > 1) m JOIN vocab v ON v.piece = m.sy[m.i] || m.sy[m.i + 1]
        GROUP BY w, step)),
last AS (SELECT w, arg_max(sy, step) AS pieces FROM merged GROUP BY w),
single AS (SELECT w, generate_subscripts(pieces, 1) AS n, unnest(pieces) AS piece FROM last),
enc AS (SELECT w, list(CAST(coalesce(v.id, {model.unk_id}) AS BIGINT) ORDER BY n) AS out, list(s.piece ORDER BY n) AS pieces FROM single s LEFT JOIN vocab v ON v.piece = s.piece GROUP BY w)"""


def bpe_unused_ctes(model: Model) -> str:
    """The same where some pieces are unused: each is taken apart into the pair that was last offered for it in its
    word, again and again. Pairs are offered from left to right at first, then on the left and the right of a merge."""
    rows = values([(p, i, float(model.scores[i]), int(model.types[i] == UNUSED)) for p, i in model.index.items()])
    return f"""vocab(piece, id, score, unused) AS (SELECT column0, column1, CAST(column2 AS FLOAT), column3 = 1 FROM (VALUES {rows}) AS t(column0, column1, column2, column3)),
merged AS (
  SELECT w, string_split(w, '') AS sy, 0 AS step, CAST(0 AS BIGINT) AS here FROM words
  UNION ALL
  SELECT w, list_concat(list_concat(sy[1 : i - 1], [sy[i] || sy[i + 1]]), sy[i + 2 : len(sy)]), step + 1, i
  FROM (SELECT w, any_value(sy) AS sy, step, -max({{'s': v.score, 'n': -i}}).n AS i
        FROM (SELECT w, sy, step, unnest(range(1, len(sy))) AS i FROM merged WHERE len(sy) > 1) m JOIN vocab v ON v.piece = m.sy[m.i] || m.sy[m.i + 1]
        GROUP BY w, step)),
offered AS (
  SELECT w, step, i AS turn, sy[i] AS l, sy[i + 1] AS r FROM (SELECT w, step, sy, unnest(range(1, len(sy))) AS i FROM merged WHERE step = 0)
  UNION ALL SELECT w, step, 1, sy[here - 1], sy[here] FROM merged WHERE step > 0 AND here > 1
  UNION ALL SELECT w, step, 2, sy[here], sy[here + 1] FROM merged WHERE step > 0 AND here < len(sy)),
apart AS (SELECT w, v.piece, arg_max([l, r], step * 1000000 + turn) AS parts FROM offered JOIN vocab v ON v.piece = l || r WHERE v.unused GROUP BY w, v.piece),
last AS (SELECT w, arg_max(sy, step) AS pieces FROM merged GROUP BY w),
single AS (
  SELECT w, generate_subscripts(pieces, 1) AS n, '' AS path, unnest(pieces) AS piece FROM last
  UNION ALL
  SELECT w, n, path || k, parts[k] FROM (SELECT s.w, s.n, s.path, a.parts, unnest([1, 2]) AS k FROM single s JOIN apart a ON a.w = s.w AND a.piece = s.piece)),
leaf AS (SELECT s.w, s.n, s.path, s.piece FROM single s LEFT JOIN apart a ON a.w = s.w AND a.piece = s.piece WHERE a.w IS NULL),
enc AS (SELECT w, list(CAST(CASE WHEN v.id IS NULL OR v.unused THEN {model.unk_id} ELSE v.id END AS BIGINT) ORDER BY n, path) AS out, list(s.piece ORDER BY n, path) AS pieces FROM leaf s LEFT JOIN vocab v ON v.piece = s.piece GROUP BY w)"""


def token_ctes(model: Model) -> str:
    """tok(k, pos, id, piece) from seg and enc: bytes of uncovered characters, or unknown runs merged, pos from 0."""
    raw = """raw AS (SELECT k, sp, generate_subscripts(out, 1) AS tp, unnest(out) AS id, unnest(pieces) AS piece FROM seg JOIN enc USING (w))"""
    if model.byte_fallback:
        first = min(i for i, p in enumerate(model.pieces) if model.types[i] == BYTE and byte_value(p) == 0)
        return raw + f""",
split AS (SELECT k, sp, tp, CASE WHEN id = {model.unk_id} THEN hex(encode(piece)) END AS h, id, piece FROM raw),
bytes AS (SELECT k, sp, tp, unnest(CASE WHEN h IS NULL THEN [NULL] ELSE list_transform(range(1, length(h), 2), lambda i: substr(h, i, 2)) END) AS b, generate_subscripts(CASE WHEN h IS NULL THEN [NULL] ELSE list_transform(range(1, length(h), 2), lambda i: substr(h, i, 2)) END, 1) AS bp, id, piece FROM split),
tok AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY sp, tp, bp) - 1 AS pos, CASE WHEN b IS NULL THEN id ELSE {first} + CAST('0x' || b AS BIGINT) END AS id, CASE WHEN b IS NULL THEN piece ELSE '<0x' || b || '>' END AS piece FROM bytes)"""
    return raw + f""",
marked AS (SELECT *, CASE WHEN id = {model.unk_id} AND lag(id) OVER o = {model.unk_id} THEN 0 ELSE 1 END AS new FROM raw WINDOW o AS (PARTITION BY k ORDER BY sp, tp)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY sp, tp) AS run FROM marked),
tok AS (SELECT k, CAST(run - 1 AS BIGINT) AS pos, min(id) AS id, string_agg(piece, '' ORDER BY sp, tp) AS piece FROM runs GROUP BY k, run)"""


def encoded(model: Model, source: str, final: str, cut: str = WORDS) -> str:
    """A query over tok and src."""
    steps = unigram_ctes if model.kind != BPE else bpe_unused_ctes if (model.types == UNUSED).any() else bpe_ctes
    return f"WITH RECURSIVE {segment_ctes(source, cut)},\n{steps(model)},\n{token_ctes(model)}\n{final}"
