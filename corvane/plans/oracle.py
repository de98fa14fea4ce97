"""The catalogue's queries as SQL for DuckDB."""

from __future__ import annotations

from ..operators.bootstrap import GOLDEN, MIX_A, MIX_B, TAG
from .views import CELL_MEANS, ITEMS, KEY, LONG, NOTES, SCORES, VARIED, ranks_sql

KEPT = "kept AS (SELECT * FROM notes WHERE text IS NOT NULL AND length(text) >= 400)"
FIRST = f"keyed AS (SELECT *, {KEY} AS key FROM kept), uniq AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY site, genre, key ORDER BY src_order) = 1)"
K3 = "site, genre, model"


def draw(seed: int, *parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 8))::BIGINT"


def rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


RANKS = f"{ITEMS}, {SCORES}, {ranks_sql()}"
MEANS = f"{RANKS}, {CELL_MEANS}"
SCOPES = "scopes AS (SELECT 'full' AS scope, unnest(range(8)) AS model UNION ALL SELECT 'contrastive', unnest(range(5)))"
SCOPED = "m AS (SELECT scopes.scope, c.* FROM cell c JOIN scopes USING (model))"


def tau(by: str, src: str = "m") -> str:
    return f"""ab AS (SELECT {by}, genre, model, min_by(mrr, site) AS a, max_by(mrr, site) AS b FROM {src} GROUP BY ALL HAVING count(DISTINCT site) = 2),
pr AS (SELECT {", ".join("x." + c.strip() for c in by.split(","))}, x.genre, sign(x.a - y.a) AS da, sign(x.b - y.b) AS db FROM ab x JOIN ab y ON {" AND ".join(f"x.{c.strip()} = y.{c.strip()}" for c in by.split(","))} AND x.genre = y.genre AND x.model < y.model),
tau AS (SELECT {by}, genre, sum(da * db) / nullif(sqrt(sum(abs(da)) * sum(abs(db))), 0) AS tau FROM pr GROUP BY ALL HAVING count(*) >= 3)"""


def overlap(by: str, src: str = "m") -> str:
    return f"""ab AS (SELECT {by}, genre, model, min_by(mrr, site) AS a, max_by(mrr, site) AS b FROM {src} GROUP BY ALL HAVING count(DISTINCT site) = 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY {by}, genre ORDER BY a DESC, model) AS ra, row_number() OVER (PARTITION BY {by}, genre ORDER BY b DESC, model) AS rb FROM ab),
ov AS (SELECT {by}, genre, count(*) FILTER (ra <= 3 AND rb <= 3) / least(3, count(*)) AS top3, count(*) FILTER (ra <= 5 AND rb <= 5) / least(5, count(*)) AS top5 FROM rk GROUP BY ALL)"""


def regret(by: str, src: str = "m", order: str = "model") -> str:
    cols = [c.strip() for c in by.split(",")]
    same = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in [*cols, "genre"])
    return f"""ch AS (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY {by}, genre, site ORDER BY mrr DESC, {order}) = 1),
wr AS (SELECT {by}, genre, site, min(mrr) AS worst FROM {src} GROUP BY ALL),
reg AS (SELECT {", ".join("x." + c for c in cols)}, x.genre, x.site AS source, y.site AS destination, x.model AS picked, y.model AS best, y.mrr - coalesce(g.mrr, w.worst) AS regret
 FROM ch x JOIN ch y ON {same("x", "y")} AND x.site <> y.site JOIN wr w ON {same("w", "y")} AND w.site = y.site LEFT JOIN {src} g ON {same("g", "y")} AND g.site = y.site AND g.model = x.model)"""


def decompose(by: str, src: str = "m") -> str:
    cols = [c.strip() for c in by.split(",")]
    on = " AND ".join(f"z.{c} = g.{c}" for c in cols)
    return f"""gm AS (SELECT {by}, avg(mrr) AS mu FROM {src} GROUP BY ALL),
cu AS (SELECT {by}, grouping_id(model, site, genre) AS gid, count(*) AS n, avg(mrr) AS mean FROM {src} GROUP BY {by}, CUBE(model, site, genre)),
ss AS (SELECT {", ".join("z." + c for c in cols)}, sum(CASE WHEN gid = 0 THEN n * (mean - mu) * (mean - mu) END) AS s0, {", ".join(f"sum(CASE WHEN gid = {i} THEN n * (mean - mu) * (mean - mu) END) AS s{i}" for i in range(1, 7))} FROM cu z JOIN gm g ON {on} GROUP BY ALL),
de AS (SELECT {by}, s3 / nullif(s0, 0) AS model, s5 / nullif(s0, 0) AS site, s6 / nullif(s0, 0) AS genre, (s1 - s3 - s5) / nullif(s0, 0) AS model_x_site, (s2 - s3 - s6) / nullif(s0, 0) AS model_x_genre,
 (s4 - s5 - s6) / nullif(s0, 0) AS site_x_genre, (s0 - s1 - s2 - s4 + s3 + s5 + s6) / nullif(s0, 0) AS model_x_site_x_genre FROM ss)"""


TERMS = "model, site, genre, model_x_site, model_x_genre, site_x_genre, model_x_site_x_genre"


def mixed(h: str) -> str:
    """The bootstrap's 32-bit mix, each step in the place of the one before."""
    m = "& 4294967295::UBIGINT"
    steps = (f"(xor(h, h >> 16) * {MIX_A}::UBIGINT) {m}", f"(xor(h, h >> 13) * {MIX_B}::UBIGINT) {m}", "xor(h, h >> 16)")
    out = f"[({h}) {m}]"
    for s in steps:
        out = f"list_transform({out}, lambda h: {s})"
    return f"{out}[1]"


def boot(replicates: int = 2000, per_cell: bool = False, values: tuple[str, ...] = ("rr",), src: str = "r", block: int = 16) -> str:
    unit = ["site", "genre"] if per_cell else ["site"]
    u = ", ".join(unit)
    join = " AND ".join(f"w.{c} = p.{c}" for c in [*unit, "patient"])
    step = f"({mixed(f'xor(h, {TAG}::UBIGINT)')} | 1::UBIGINT)"
    number = lambda below: f"({mixed('h + slot::UBIGINT * g')} % {below}::UBIGINT)::BIGINT"
    return f"""rp AS (SELECT *, doc_idx // 3 AS patient FROM {src}),
cl AS (SELECT *, row_number() OVER (PARTITION BY {u} ORDER BY md5(patient::VARCHAR), patient) - 1 AS ix, count(*) OVER (PARTITION BY {u}) AS nc FROM (SELECT DISTINCT {u}, patient FROM rp)),
sz AS (SELECT {u}, nc, {draw(42, *unit)}::UBIGINT AS us FROM (SELECT DISTINCT {u}, nc FROM cl)),
rb AS (SELECT unnest(range({replicates})) AS replicate),
h0 AS (SELECT {u}, nc, replicate, {mixed(f'us + replicate::UBIGINT * {GOLDEN}::UBIGINT')} AS hr FROM sz, rb),
h1 AS (SELECT *, {mixed('hr')} AS h FROM h0), h2 AS (SELECT *, {step} AS g FROM h1),
s1 AS (SELECT *, unnest(range(nc)) AS slot FROM h2),
b1 AS (SELECT {u}, nc, replicate, hr, {number('nc')} // {block} AS part, count(*) AS c FROM s1 GROUP BY ALL),
h3 AS (SELECT *, least({block}, nc - part * {block}) AS m, {mixed(f'hr + (part + 1)::UBIGINT * {GOLDEN}::UBIGINT')} AS h FROM b1), h4 AS (SELECT *, {step} AS g FROM h3),
s2 AS (SELECT *, unnest(range(c)) AS slot FROM h4),
dr AS (SELECT replicate, {u}, part * {block} + {number('m')} AS ix, count(*) AS w FROM s2 GROUP BY ALL),
w AS (SELECT dr.replicate, {", ".join("dr." + c for c in unit)}, cl.patient, dr.w FROM dr JOIN cl ON {" AND ".join(f"dr.{c} = cl.{c}" for c in [*unit, "ix"])}),
ps AS (SELECT {K3}, patient, {", ".join(f"sum({v}) AS {v}" for v in values)}, count(*) AS n FROM rp GROUP BY ALL),
bm AS (SELECT w.replicate, p.site, p.genre, p.model, {", ".join(f"round(sum(w.w * p.{v}) / sum(w.w * p.n), 12) AS {v}" for v in values)} FROM w JOIN ps p ON {join} GROUP BY ALL)"""


BOOTED = f"{RANKS}, {boot()}, {SCOPES}, m AS (SELECT scopes.scope, b.replicate, b.site, b.genre, b.model, b.rr AS mrr FROM bm b JOIN scopes USING (model))"


def interval(by: str, value: str, src: str) -> str:
    return f"SELECT {by}, round(avg({value}), 6) AS boot_mean, round(quantile_cont({value}, 0.025), 6) AS lo, round(quantile_cont({value}, 0.975), 6) AS hi FROM {src} GROUP BY ALL"


def null_curve(sample: int) -> str:
    return f"""dk AS (SELECT {K3}, doc_idx, count(*) AS k FROM d GROUP BY ALL),
tk AS (SELECT * FROM dk QUALIFY row_number() OVER (PARTITION BY {K3} ORDER BY {draw(42, "'doc'", "site", "genre", "model", "doc_idx")}, doc_idx) <= {sample}),
qn AS (SELECT *, row_number() OVER (PARTITION BY {K3} ORDER BY doc_idx) - 1 AS q_no, count(*) OVER (PARTITION BY {K3}) AS n_q FROM q),
dq AS (SELECT t.*, o.q_no AS own_no, o.n_q, {draw(42, "'query'", "t.site", "t.genre", "t.model", "t.doc_idx")} % o.n_q AS drawn FROM tk t JOIN qn o USING (site, genre, model, doc_idx)),
pk AS (SELECT *, CASE WHEN drawn = own_no THEN (drawn + 1) % n_q ELSE drawn END AS qq FROM dq),
sc AS (SELECT p.site, p.genre, p.model, p.doc_idx, p.k, max(list_inner_product(y.v, d.v)) AS score FROM pk p JOIN qn y ON p.site = y.site AND p.genre = y.genre AND p.model = y.model AND p.qq = y.q_no
  JOIN d ON d.site = p.site AND d.genre = p.genre AND d.model = p.model AND d.doc_idx = p.doc_idx GROUP BY ALL),
nc AS (SELECT {K3}, k, avg(score) AS null_mean, count(*) AS n FROM sc GROUP BY ALL)"""


def null_at(curve: str, wanted: str) -> str:
    """Of ``wanted`` rows with cell, model and k."""
    return f"""nv0 AS (SELECT w.site, w.genre, w.model, w.k, max(c.k) FILTER (c.k <= w.k) AS k0, min(c.k) FILTER (c.k >= w.k) AS k1, max_by(c.null_mean, c.k) FILTER (c.k <= w.k) AS v0, min_by(c.null_mean, c.k) FILTER (c.k >= w.k) AS v1
  FROM (SELECT DISTINCT {K3}, k FROM {wanted}) w JOIN {curve} c USING (site, genre, model) GROUP BY ALL),
nv AS (SELECT {K3}, k, CASE WHEN k0 IS NULL THEN v1 WHEN k1 IS NULL OR k0 = k1 THEN v0 ELSE v0 + (v1 - v0) * (k - k0) / (k1 - k0) END AS null_value FROM nv0)"""


MEAN_V = "SELECT {keys}, list(x ORDER BY pos) AS v FROM (SELECT {keys}, pos, avg(x) AS x FROM (SELECT {keys}, unnest(range(len({v}))) AS pos, unnest({v}) AS x FROM {src}) GROUP BY ALL) GROUP BY ALL"


def mean_v(keys: str, src: str, v: str = "v") -> str:
    return MEAN_V.format(keys=keys, src=src, v=v)


def unit(v: str) -> str:
    return f"list_transform({v}, lambda y: y / greatest(sqrt(list_inner_product({v}, {v})), 1e-9))"


CENTRED = f"""{ITEMS.replace("q AS (", "q9 AS (").replace("d AS (", "d9 AS (")}, mu AS ({mean_v(K3, "d9")}),
q8 AS (SELECT q9.* EXCLUDE (v), list_transform(list_zip(q9.v, mu.v), lambda z: z[1] - z[2]) AS u FROM q9 JOIN mu USING (site, genre, model)), q AS (SELECT * EXCLUDE (u), {unit("u")} AS v FROM q8),
d8 AS (SELECT d9.* EXCLUDE (v), list_transform(list_zip(d9.v, mu.v), lambda z: z[1] - z[2]) AS u FROM d9 JOIN mu USING (site, genre, model)), d AS (SELECT * EXCLUDE (u), {unit("u")} AS v FROM d8)"""


def mean_cosine(src: str) -> str:
    return f"""u AS (SELECT {K3}, {unit("v")} AS u FROM {src}), tt AS (SELECT {K3}, count(*) AS n, sum(list_inner_product(u, u)) AS own FROM u GROUP BY ALL), mv AS ({mean_v(K3, "u", "u")}),
mc AS (SELECT {K3}, (list_inner_product(v, v) * n * n - own) / nullif(n::DOUBLE * (n - 1), 0) AS mean_cos FROM tt JOIN mv USING (site, genre, model))"""


TOKENS = "regexp_extract_all(text, '[^\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B]+')"
LABEL = "CASE WHEN mean_cos < 0.25 THEN 'isotropic' WHEN mean_cos < 0.5 THEN 'mild' ELSE 'anisotropic' END"
WORDS = f"list_filter(string_split({KEY}, ' '), lambda w: w <> '')"


def doc_frequency(src: str) -> str:
    return f"df AS (SELECT site, genre, word, count(*) AS df FROM (SELECT site, genre, src_order, unnest(list_distinct({WORDS})) AS word FROM {src}) GROUP BY ALL)"


KEY_OF = lambda c: KEY.replace("(text)", f"({c})")

def _sensitivity() -> str:
    """Five policies side by side: windows, scores or both sides' vectors differ, and the rest is the same."""
    windows = {
        "maxsim": "SELECT * FROM d",
        "mean": f"SELECT {K3}, doc_idx, 0 AS chunk_no, {unit('v')} AS v FROM ({mean_v(K3 + ', doc_idx', 'd')})",
        "single-random": f"SELECT {K3}, doc_idx, chunk_no, v FROM (SELECT *, row_number() OVER (PARTITION BY {K3}, doc_idx ORDER BY chunk_no) - 1 AS place, {draw(42, 'site', 'genre', 'model', 'doc_idx')} % count(*) OVER (PARTITION BY {K3}, doc_idx) AS drawn FROM d) WHERE place = drawn",
    }
    less = lambda side: f"(SELECT {side}.* EXCLUDE (v), {unit('u')} AS v FROM (SELECT {side}.*, list_transform(list_zip({side}.v, mu.v), lambda z: z[1] - z[2]) AS u FROM {side} JOIN mu USING (site, genre, model)) {side})"
    ctes = [VARIED]
    for i, w in enumerate(windows.values()):
        ctes += [f"w{i} AS ({w})", SCORES.replace("s AS (", f"s{i} AS (").replace("JOIN d ON", f"JOIN w{i} d ON")]
    ctes += [null_curve(600), null_at("nc", "dk"), "s3 AS (SELECT s0.site, s0.genre, s0.model, s0.query_idx, s0.doc_idx, s0.score - nv.null_value AS score FROM s0 JOIN dk USING (site, genre, model, doc_idx) JOIN nv USING (site, genre, model, k))"]
    ctes += [f"mu AS ({mean_v(K3, 'd')})", f"qc AS {less('q')}", f"dc AS {less('d')}", SCORES.replace("s AS (", "s4 AS (").replace("FROM q JOIN d ON", "FROM qc q JOIN dc d ON")]
    ctes += [ranks_sql(f"s{i}", f"rk{i}_") for i in range(5)]
    means = [f"SELECT '{policy}' AS policy, {K3}, avg(rr) AS mrr FROM rk{i}_ GROUP BY ALL" for i, policy in enumerate((*windows, "length-norm", "centred"))]
    verdict = "CASE WHEN genre >= 0.3 AND genre >= model THEN 'survives' WHEN genre >= 0.25 THEN 'comparable' ELSE 'collapses' END AS verdict"
    return f"WITH {', '.join(ctes)}, {SCOPES}, c AS ({' UNION ALL '.join(means)}), m AS (SELECT scopes.scope, c.* FROM c JOIN scopes USING (model)), {decompose('policy, scope')} SELECT policy, scope, {rounded(*TERMS.split(', '))}, {verdict} FROM de"


def _linear(prefix: str, windowed: bool) -> str:
    """The linear encoder over whole texts: marks, codes, masked means, and pooling, for one panel of three models."""
    cut = "unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 510 THEN 1 ELSE ceil((len(w) - 510) / 384)::INT + 1 END))" if windowed else "0"
    code = lambda d: f"list_transform(ids, lambda y: (y % {d})::DOUBLE)"
    parts = [f"avg_{d} * 2" for d in (5, 7, 11, 13)]
    first = [f"avg_{d} + 2 % {d}" for d in (5, 7, 11, 13)]
    pick = [f"CASE WHEN pooling = 'cls' THEN {f} ELSE {p} END AS x{i}" for i, (f, p) in enumerate(zip(first, parts, strict=True))]
    size = "greatest(sqrt(" + " + ".join(f"x{i} * x{i}" for i in range(4)) + "), 1e-9)"
    return f"""pn AS (SELECT * FROM (VALUES ('plain', '', 'mean'), ('first', '', 'cls'), ('prefixed', '{prefix}', 'mean')) t(model, prefix, pooling)),
tx AS (SELECT model, pooling, src_order AS doc_idx, prefix || text AS text FROM notes, pn), tw AS (SELECT model, pooling, doc_idx, {TOKENS} AS w FROM tx),
wn AS (SELECT *, {cut} AS chunk_no FROM tw), ww AS (SELECT model, pooling, doc_idx, chunk_no, w[chunk_no * 384 + 1 : chunk_no * 384 + 510] AS w FROM wn),
wi AS (SELECT model, pooling, doc_idx, chunk_no, list_concat(list_concat([2::BIGINT], list_transform(w, lambda y: 64 * unicode(y)::BIGINT + least(length(y), 63))), [1::BIGINT]) AS ids FROM ww),
av AS (SELECT model, pooling, doc_idx, chunk_no, {", ".join(f"list_avg({code(d)}) AS avg_{d}" for d in (5, 7, 11, 13))} FROM wi),
pv AS (SELECT model, doc_idx, chunk_no, {", ".join(pick)} FROM av), nv AS (SELECT model, doc_idx, chunk_no, {", ".join(f"round((x{i} / {size})::FLOAT::DOUBLE, 4) AS v{i}" for i in range(4))} FROM pv)"""


NARRATIVE = lambda src: f"""{doc_frequency(src)}, nd AS (SELECT site, genre, count(*) AS n_docs FROM {src} GROUP BY ALL),
fl AS (SELECT site, genre, src_order, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g') AS t FROM {src}),
se AS (SELECT site, genre, src_order, unnest(string_split(t, chr(1))) AS text, unnest(range(len(string_split(t, chr(1))))) AS at_ FROM fl),
sw AS (SELECT *, {WORDS} AS words FROM se), ew AS (SELECT site, genre, src_order, at_, text, unnest(words) AS word FROM sw WHERE len(words) BETWEEN 8 AND 40),
sc AS (SELECT site, genre, src_order, at_, text, round(avg(ln(n_docs / df)), 9) AS rarity FROM ew JOIN df USING (site, genre, word) JOIN nd USING (site, genre) GROUP BY ALL),
nq AS (SELECT site, genre, src_order, text AS query FROM sc QUALIFY row_number() OVER (PARTITION BY site, genre, src_order ORDER BY rarity DESC, at_) = 1)"""  # noqa: E731
CANON = lambda c: f"list_transform({c}, lambda y: regexp_replace(lower(y), '[^a-z]', '', 'g'))"
#: Queries taken out of their documents: places, spans, agreements, and what is left.
EXCLUDED = f"""{NOTES}, {KEPT}, {FIRST}, l AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM uniq GROUP BY site, genre)),
pool AS (SELECT site, genre, src_order, text FROM (SELECT *, row_number() OVER (PARTITION BY site, genre ORDER BY md5('42:' || src_order), src_order) AS place FROM uniq), l WHERE place <= least),
{NARRATIVE("pool")},
tw AS (SELECT src_order, site, genre, query, {TOKENS} AS raw, list_filter({CANON(TOKENS.replace("(text,", "(query,"))}, lambda y: length(y) >= 2) AS want FROM pool JOIN nq USING (site, genre, src_order)),
tb AS (SELECT *, {CANON("raw")} AS bare FROM tw),
pl AS (SELECT src_order, want, bare, unnest(range(len(bare))) AS place FROM tb WHERE len(want) >= 5),
nr AS (SELECT src_order, want, place, bare[place + 1 : place + len(want) * 5 // 2 + 10] AS near FROM pl WHERE bare[place + 1] = want[1]),
en AS (SELECT *, unnest(range(len(near))) AS e FROM nr),
sp AS (SELECT src_order, want, place, e, list_filter(near[1 : e + 1], lambda y: y <> '') AS span FROM en WHERE near[e + 1] = want[-1]),
sh AS (SELECT src_order, place, e, len(list_filter(span, lambda y: list_contains(want, y))) / len(span) AS own, len(list_distinct(list_filter(span, lambda y: list_contains(want, y)))) / len(list_distinct(want)) AS found FROM sp),
b1 AS (SELECT src_order, place AS b, place + e + 1 AS e FROM sh WHERE own >= 0.6 AND found >= 0.6 QUALIFY row_number() OVER (PARTITION BY src_order ORDER BY place, own + found DESC, e) = 1),
ag AS (SELECT *, unnest(range(5, len(want) + 1)) AS n FROM nr),
b2 AS (SELECT src_order, place AS b, place + 2 * n AS e FROM ag WHERE list_filter(near[1 : 2 * n], lambda y: y <> '')[1 : n] = want[1 : n] QUALIFY row_number() OVER (PARTITION BY src_order ORDER BY n DESC, place) = 1),
cu1 AS (SELECT site, genre, src_order, query, raw, coalesce(b1.b, b2.b, 0) AS b, coalesce(b1.e, b2.e, 0) AS e FROM tb LEFT JOIN b1 USING (src_order) LEFT JOIN b2 USING (src_order)),
tg AS (SELECT site, genre, src_order, query, array_to_string(list_concat(raw[1 : b], raw[e + 1 :]), ' ') AS target FROM cu1),
lk AS (SELECT *, substr({KEY_OF("query")}, 1, 60) AS head, {KEY_OF("target")} AS key FROM tg WHERE length(target) >= 100),
ex AS (SELECT site, genre, src_order, query, target, head, key FROM lk WHERE NOT (head <> '' AND contains(key, head)))"""


ORACLE_SQL = {
    "note_scan_min_chars": "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) >= 400",
    "note_era_share": f"""WITH {NOTES} SELECT site, genre, min(year) AS min_year, max(year) AS max_year, quantile_cont(year, 0.5)::DOUBLE AS median_year, round(avg((year BETWEEN 2008 AND 2019)::INT), 6) AS share_era,
 round(avg((year < 2020)::INT), 6) AS share_before_2020, min(year) > 2090 AS shifted, count(*) AS n FROM notes WHERE year IS NOT NULL AND year <> 0 GROUP BY ALL""",
    "norm_key": f"SELECT doc_id, {KEY} AS key FROM documents",
    "canon_tokens": f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents), c AS (SELECT doc_id, w, list_transform(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')) AS c FROM w)
SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_filter(c, lambda x: x <> ''))::BIGINT AS n_canon, array_to_string(c, ' ') AS canon FROM c""",
    "token_windows": f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents), n AS (SELECT *, CASE WHEN len(w) <= 51 THEN 1 ELSE ceil((len(w) - 51) / 38)::INT + 1 END AS c FROM w WHERE len(w) > 0),
i AS (SELECT doc_id, w, unnest(range(c)) AS window_no FROM n), s AS (SELECT doc_id, window_no, list_slice(w, window_no * 38 + 1, window_no * 38 + 51) AS w FROM i)
SELECT doc_id, window_no, len(w)::BIGINT AS n, w[1] AS first, w[-1] AS last FROM s""",
    "leak_guard": f"""WITH {NOTES}, p AS (SELECT site, genre, substr(text, 1, 90) AS query, CASE WHEN src_order % 3 = 0 THEN text ELSE substr(text, 91) END AS target FROM notes),
k AS (SELECT site, genre, substr({KEY_OF("query")}, 1, 60) AS head, {KEY_OF("target")} AS key FROM p) SELECT site, genre, count(*) FILTER (head <> '' AND contains(key, head)) AS n_leaks, count(*) AS n FROM k GROUP BY ALL""",
    "doc_frequency": f"WITH {NOTES}, {doc_frequency('notes')} SELECT * FROM df",
    "narrative_query": f"WITH {NOTES}, {KEPT}, {FIRST}, {NARRATIVE('uniq')} SELECT * FROM nq",
    "query_exclusion": f"WITH {EXCLUDED} SELECT site, genre, src_order, query, target FROM ex",
    "leak_proof": f"WITH {EXCLUDED} SELECT site, genre, count(*) FILTER (head <> '' AND contains(key, head)) AS n_leaks, count(*) AS n FROM ex GROUP BY ALL",
    "dedup_keep_first": f"WITH {NOTES}, {KEPT}, {FIRST} SELECT site, genre, src_order, patient, year FROM uniq",
    "attrition": f"WITH {NOTES}, {KEPT}, {FIRST} SELECT site, genre, count(*) AS n_before, count(DISTINCT key) AS n_after, count(*) - count(DISTINCT key) AS n_dropped FROM keyed GROUP BY ALL",
    "equalized_pool": f"""WITH {NOTES}, {KEPT}, {FIRST}, l AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM uniq GROUP BY site, genre))
SELECT site, genre, src_order FROM (SELECT *, row_number() OVER (PARTITION BY site, genre ORDER BY md5('42:' || src_order), src_order) AS place FROM uniq), l WHERE place <= least""",
    "matched_n": f"""WITH {NOTES}, {KEPT}, l AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM kept GROUP BY site, genre))
SELECT site, genre, src_order, place - 1 AS doc_idx FROM (SELECT *, row_number() OVER (PARTITION BY site, genre ORDER BY md5('43:' || src_order), src_order) AS place FROM kept), l WHERE place <= least""",
    "audit_distinct_counts": f"WITH {NOTES}, {KEPT} SELECT site, genre, count(*) AS n_rows, count(DISTINCT src_order) AS n_keys, count(DISTINCT text) AS n_texts, count(DISTINCT {KEY}) AS n_normalised, count(DISTINCT patient) AS n_patients FROM kept GROUP BY ALL",
    "docs_per_patient": f"""WITH {NOTES}, e AS (SELECT site, genre, patient, count(*) AS n FROM notes GROUP BY ALL)
SELECT site, genre, quantile_cont(n, 0.5)::DOUBLE AS median_docs, max(n) AS max_docs, round(avg((n > 1)::INT), 6) AS share_several, avg((n > 1)::INT) > 0.05 AS clustered FROM e GROUP BY ALL""",
    "year_bucket_hist": f"WITH {NOTES} SELECT (year // 5 * 5)::VARCHAR || 's' AS bucket, count(*) AS n FROM notes WHERE year IS NOT NULL GROUP BY ALL",
    "audit_roll_up": f"WITH {NOTES}, {KEPT}, c AS (SELECT site, genre, count(*) AS n_rows, count(DISTINCT {KEY}) AS n_normalised FROM kept GROUP BY ALL) SELECT *, n_rows - n_normalised AS n_dropped, min(n_normalised) OVER () AS matched_bound FROM c",
    "truncation_share": f"WITH {NOTES}, w AS (SELECT site, genre, len({TOKENS}) AS n FROM notes) SELECT site, genre, round(avg((n + 2 >= 512)::INT), 6) AS share_truncated, count(*) AS n FROM w GROUP BY ALL",
    "sim_top10": f"""WITH {ITEMS}, {SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY {K3}, query_idx ORDER BY score DESC, doc_idx) AS rank, count(*) OVER (PARTITION BY {K3}, query_idx) AS n FROM s)
SELECT {K3}, query_idx, doc_idx, round(score, 6) AS score, rank FROM k WHERE rank <= least(10, n - 1)""",
    "rr_maxsim": f"WITH {RANKS} SELECT {K3}, doc_idx, rank, round(rr, 6) AS rr, hit1, hit10 FROM r",
    "rr_blocks": f"WITH {RANKS} SELECT {K3}, doc_idx, rank, round(rr, 6) AS rr FROM r",
    "rr_pruned": f"WITH {RANKS} SELECT {K3}, doc_idx, rank, round(rr, 6) AS rr FROM r",
    "rr_single_vector": f"WITH {ITEMS}, {SCORES.replace('GROUP BY ALL', 'WHERE d.chunk_no = 1 GROUP BY ALL')}, {ranks_sql()} SELECT {K3}, doc_idx, rank, round(rr, 6) AS rr, hit1, hit10 FROM r",
    "mrr_by_cell": f"WITH {MEANS} SELECT {K3}, round(mrr, 6) AS mrr, n FROM cell",
    "hit_at_k": f"WITH {MEANS} SELECT {K3}, {rounded('hit1', 'hit10')} FROM cell",
    "panel_mean_hit": f"WITH {MEANS} SELECT site, genre, round(avg(hit1), 6) AS hit1, round(avg(hit10), 6) AS hit10 FROM cell GROUP BY ALL",
    "score_mean_pool": f"WITH {ITEMS.replace('d AS (', 'd9 AS (')}, d8 AS ({mean_v(K3 + ', doc_idx', 'd9')}), d AS (SELECT {K3}, doc_idx, {unit('v')} AS v FROM d8), {SCORES}, {ranks_sql()}, {CELL_MEANS} SELECT {K3}, round(mrr, 6) AS mrr FROM cell",
    "score_single_random": f"""WITH {VARIED.replace('d AS (', 'd9 AS (')}, d8 AS (SELECT *, row_number() OVER (PARTITION BY {K3}, doc_idx ORDER BY chunk_no) - 1 AS place, {draw(42, 'site', 'genre', 'model', 'doc_idx')} % count(*) OVER (PARTITION BY {K3}, doc_idx) AS drawn FROM d9),
d AS (SELECT * FROM d8 WHERE place = drawn), {SCORES}, {ranks_sql()}, {CELL_MEANS} SELECT {K3}, round(mrr, 6) AS mrr FROM cell""",
    "null_curve": f"WITH {VARIED}, {null_curve(600)} SELECT {K3}, k, round(null_mean, 6) AS null_mean, n FROM nc",
    "null_interp": f"WITH {VARIED}, {null_curve(600)}, c AS (SELECT * FROM nc WHERE k <> 2), wanted AS (SELECT {K3}, unnest(range(7)) AS k FROM (SELECT DISTINCT {K3} FROM c)), {null_at('c', 'wanted')} SELECT {K3}, k, round(null_value, 6) AS null_value FROM nv",
    "score_length_norm": f"""WITH {VARIED}, {SCORES}, {null_curve(600)}, {null_at('nc', 'dk')}, sl AS (SELECT s.site, s.genre, s.model, s.query_idx, s.doc_idx, s.score - nv.null_value AS score FROM s JOIN dk USING (site, genre, model, doc_idx) JOIN nv USING (site, genre, model, k)),
{ranks_sql('sl')}, {CELL_MEANS} SELECT {K3}, round(mrr, 6) AS mrr FROM cell""",
    "null_bands": f"""WITH {LONG}, {null_curve(600)}, b AS (SELECT *, CASE WHEN k = 1 THEN '1' WHEN k <= 4 THEN '2-4' WHEN k <= 8 THEN '5-8' WHEN k <= 15 THEN '9-15' WHEN k <= 60 THEN '16-60' END AS band FROM nc)
SELECT {K3}, band, round(avg(null_mean), 6) AS null_mean FROM b WHERE band IS NOT NULL GROUP BY ALL""",
    "di_gap": f"WITH {MEANS}, g AS (SELECT site, model, max(mrr) FILTER (genre = 0) AS d, max(mrr) FILTER (genre = 1) AS i FROM cell GROUP BY ALL) SELECT round(avg(d - i), 6) AS gap FROM g",
    "median_chunks": f"WITH {VARIED}, c AS (SELECT site, genre, doc_idx, count(*) AS n FROM d WHERE model = 0 GROUP BY ALL) SELECT site, genre, quantile_cont(n, 0.5)::DOUBLE AS median_chunks FROM c GROUP BY ALL",
    "l2_normalize": f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS w FROM embeddings), u AS (SELECT vec_id, {unit('w')} AS u FROM e) SELECT vec_id, round(sqrt(list_inner_product(u, u)), 6) AS norm, round(u[1], 6) AS first FROM u",
    "anisotropy": f"""WITH {ITEMS}, s0 AS (SELECT *, row_number() OVER (PARTITION BY {K3} ORDER BY {draw(42, 'site', 'genre', 'model', 'doc_idx', 'chunk_no')}, doc_idx, chunk_no) AS place FROM d),
s AS (SELECT {K3}, place, sqrt(list_inner_product(v, v)) AS size, {unit('v')} AS u FROM s0 WHERE place <= 2000), c0 AS ({mean_v(K3, 's', 'u')}), c AS (SELECT {K3}, {unit('v')} AS c FROM c0),
a AS (SELECT {K3}, avg(size) AS mean_norm, avg(list_inner_product(u, c)) AS centroid_cos FROM s JOIN c USING (site, genre, model) GROUP BY ALL),
o AS (SELECT x.site, x.genre, x.model, avg(list_inner_product(x.u, y.u)) AS mean_cos, quantile_cont(list_inner_product(x.u, y.u), 0.95) AS p95_cos FROM s x JOIN s y ON x.site = y.site AND x.genre = y.genre AND x.model = y.model AND x.place < y.place GROUP BY ALL)
SELECT {K3}, {rounded('mean_cos', 'p95_cos', 'mean_norm', 'centroid_cos')} FROM o JOIN a USING (site, genre, model)""",
    "encoded_windows": f"WITH {NOTES}, {_linear('passage: ', True)} SELECT model, doc_idx, chunk_no, v0, v1, v2, v3 FROM nv",
    "encoded_queries": f"WITH {NOTES}, {_linear('query: ', False)} SELECT model, doc_idx, v0, v1, v2, v3 FROM nv",
    "truncation_observed": f"WITH {NOTES}, w AS (SELECT site, genre, len({TOKENS}) AS n FROM notes) SELECT site, genre, round(avg((n + 2 >= 512)::INT), 6) AS share_truncated, count(*) AS n FROM w GROUP BY ALL",
    "vectors_stored": f"WITH {ITEMS} SELECT site, genre, model, doc_idx, round(max(list_inner_product(q.v, d.v)), 6) AS own, count(*) AS n_windows FROM q JOIN d USING (site, genre, model, doc_idx) GROUP BY ALL",
    "component_percentiles": """WITH e AS (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
SELECT pos % 4 AS part, round(quantile_cont(abs(x::DOUBLE), 0.025), 6) AS low, round(quantile_cont(abs(x::DOUBLE), 0.5), 6) AS middle, round(quantile_cont(abs(x::DOUBLE), 0.95), 6) AS high FROM e GROUP BY ALL""",
    "vector_tau": f"""WITH e AS (SELECT vec_id AS model, unnest(range(1, 8)) AS genre, embedding[1]::DOUBLE AS f, unnest(embedding[2:8])::DOUBLE AS x FROM embeddings),
m AS (SELECT 1 AS one, genre, model, 0 AS site, f AS mrr FROM e UNION ALL SELECT 1, genre, model, 1, x FROM e), {tau('one')} SELECT genre, round(tau, 6) AS tau FROM tau""",
    "anisotropy_closed_form": f"WITH {ITEMS}, {mean_cosine('d')} SELECT {K3}, round(mean_cos, 6) AS mean_cos FROM mc",
    "anisotropy_label": f"WITH {ITEMS}, {mean_cosine('d')}, g AS (SELECT model, avg(mean_cos) AS mean_cos FROM mc GROUP BY ALL) SELECT model, round(mean_cos, 6) AS mean_cos, {LABEL} AS label FROM g",
    "null_slope": f"""WITH {LONG}, {null_curve(800)}, f AS (SELECT {K3}, min_by(null_mean, k) AS floor, sum(null_mean * n) FILTER (k >= 5) / sum(n) FILTER (k >= 5) AS high FROM nc GROUP BY ALL)
SELECT {K3}, {rounded('floor', 'high')}, round(high - floor, 6) AS slope, round((high - floor) / nullif(floor, 0), 6) AS ratio FROM f""",
    "mean_center_mrr": f"WITH {CENTRED}, {SCORES}, {ranks_sql()}, {CELL_MEANS} SELECT {K3}, round(mrr, 6) AS mrr FROM cell",
    "offdiag_after_centering": f"WITH {CENTRED}, d1 AS (SELECT * FROM d WHERE model = 1), {mean_cosine('d1')} SELECT model, round(avg(mean_cos), 6) AS mean_cos FROM mc GROUP BY ALL",
    "kendall_tau": f"WITH {MEANS}, {SCOPES}, {SCOPED}, {tau('scope')} SELECT scope, genre, round(tau, 6) AS tau FROM tau",
    "kendall_tau_runs": f"WITH {MEANS}, {SCOPES}, {SCOPED}, {tau('scope')} SELECT scope, genre, round(tau, 6) AS tau FROM tau",
    "topk_overlap": f"WITH {MEANS}, {SCOPES}, {SCOPED}, {overlap('scope')} SELECT scope, genre, {rounded('top3', 'top5')} FROM ov",
    "selection_regret": f"WITH {MEANS}, {SCOPES}, {SCOPED}, {regret('scope')} SELECT scope, genre, source, destination, picked, best, round(regret, 6) AS regret FROM reg",
    "variance_decomp": f"WITH {MEANS}, {SCOPES}, {SCOPED}, {decompose('scope')} SELECT scope, {rounded(*TERMS.split(', '))} FROM de",
    "scoring_sensitivity": _sensitivity(),
    "interaction_contrast": f"""WITH {RANKS}, {boot()}, m AS (SELECT replicate, {K3}, rr AS mrr FROM bm), {decompose('replicate')}, v AS (SELECT 'contrast' AS term, model_x_site - model_x_genre AS value FROM de),
i AS ({interval('term', 'value', 'v')}), j AS (SELECT quantile_cont(value, 0.025) AS lo9, quantile_cont(value, 0.975) AS hi9 FROM v)
SELECT i.*, CASE WHEN lo9 > 0 THEN 'site larger' WHEN hi9 < 0 THEN 'genre larger' ELSE 'undecided' END AS verdict FROM i, j""",
    "boot_mrr_ci": f"WITH {RANKS}, {boot(per_cell=True)}, i AS ({interval(K3, 'rr', 'bm')}), p AS (SELECT {K3}, avg(rr) AS mrr FROM r GROUP BY ALL) SELECT {K3}, round(mrr, 6) AS mrr, boot_mean, lo, hi FROM p JOIN i USING (site, genre, model)",
    "boot_joint_mrr": f"WITH {RANKS}, {boot()} SELECT replicate, {K3}, round(rr, 9) AS rr FROM bm",
    "boot_hit_ci": f"""WITH {RANKS}, {boot(values=('hit1', 'hit10'))}, h AS (SELECT replicate, site, genre, avg(hit1) AS hit1, avg(hit10) AS hit10 FROM bm GROUP BY ALL),
l AS (SELECT site, genre, 'hit1' AS term, hit1 AS value FROM h UNION ALL SELECT site, genre, 'hit10', hit10 FROM h) {interval('site, genre, term', 'value', 'l')}""",
    "boot_tau_ci": f"WITH {BOOTED}, {tau('scope, replicate')} {interval('scope, genre', 'tau', 'tau')}",
    "boot_regret_ci": f"WITH {BOOTED}, {regret('scope, replicate')} {interval('scope, genre, source, destination', 'regret', 'reg')}",
    "boot_overlap_ci": f"WITH {BOOTED}, {overlap('scope, replicate')}, l AS (SELECT scope, genre, 'top3' AS term, top3 AS value FROM ov UNION ALL SELECT scope, genre, 'top5', top5 FROM ov) {interval('scope, genre, term', 'value', 'l')}",
    "boot_decomp_ci": f"WITH {BOOTED}, {decompose('scope, replicate')}, l AS (SELECT scope, unnest([{', '.join(repr(t) for t in TERMS.split(', '))}]) AS term, unnest([{TERMS}]) AS value FROM de) {interval('scope, term', 'value', 'l')}",
    "boot_cell_decomp_ci": f"WITH {RANKS}, {boot(per_cell=True)}, {SCOPES}, m AS (SELECT scopes.scope, b.replicate, b.site, b.genre, b.model, b.rr AS mrr FROM bm b JOIN scopes USING (model)), {decompose('scope, replicate')}, l AS (SELECT scope, unnest([{', '.join(repr(t) for t in TERMS.split(', '))}]) AS term, unnest([{TERMS}]) AS value FROM de) {interval('scope, term', 'value', 'l')}",
    "genre_drop": f"""WITH {VARIED}, {SCORES}, {null_curve(600)}, {null_at('nc', 'dk')}, sl AS (SELECT s.site, s.genre, s.model, s.query_idx, s.doc_idx, s.score - nv.null_value AS score FROM s JOIN dk USING (site, genre, model, doc_idx) JOIN nv USING (site, genre, model, k)),
{ranks_sql('s', 'ra')}, {ranks_sql('sl', 'rb')}, {SCOPES}, c AS (SELECT 'maxsim' AS policy, {K3}, avg(rr) AS mrr FROM ra GROUP BY ALL UNION ALL SELECT 'length-norm', {K3}, avg(rr) FROM rb GROUP BY ALL), m AS (SELECT scopes.scope, c.* FROM c JOIN scopes USING (model)), {decompose('policy, scope')},
w AS (SELECT scope, max(genre) FILTER (policy = 'maxsim') AS before, max(genre) FILTER (policy = 'length-norm') AS after FROM de GROUP BY ALL)
SELECT scope, {rounded('before', 'after')}, round(CASE WHEN before = 0 THEN 0 ELSE (before - after) / before END, 6) AS drop_ratio FROM w""",
    "encounters_per_patient": f"""WITH {NOTES}, e AS (SELECT site, patient, count(*) AS n FROM notes WHERE patient IS NOT NULL GROUP BY ALL), t AS (SELECT site, count(*) AS n_encounters FROM notes GROUP BY ALL)
SELECT site, any_value(n_encounters) AS n_encounters, count(*) AS n_patients, quantile_cont(n, 0.5)::DOUBLE AS median_encounters, max(n) AS max_encounters, round(avg((n > 1)::INT), 6) AS share_several FROM e JOIN t USING (site) GROUP BY site""",
    "long_notes_read": f"WITH {NOTES}, {KEPT} SELECT 'a' AS site, 'discharge' AS genre, src_order::VARCHAR AS doc_key, patient, year, sha256(text) AS digest FROM kept",
    "wide_notes_read": f"WITH {NOTES}, {KEPT} SELECT 'b' AS site, CASE WHEN genre = 'en' THEN 'discharge' ELSE 'imaging' END AS genre, src_order::VARCHAR AS doc_key, patient, year, sha256(text) AS digest FROM kept",
    "ranks_stored": f"WITH {RANKS} SELECT {K3}, doc_idx, round(rr, 6) AS rr FROM r WHERE model IN (1, 5)",
    "cells_stored": f"""WITH {NOTES}, {KEPT}, l AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM kept GROUP BY site, genre))
SELECT site, genre, src_order, place - 1 AS doc_idx, sha256(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY site, genre ORDER BY md5('43:' || src_order), src_order) AS place FROM kept), l WHERE place <= least""",
    "mrr_json_stored": f"WITH {MEANS} SELECT site::VARCHAR AS site, genre::VARCHAR AS genre, model::VARCHAR AS model, round(mrr, 6) AS mrr, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, n AS obj FROM cell",
}

