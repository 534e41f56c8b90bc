"""SQL that gives the results of the core queries by other means, for the oracle."""

from __future__ import annotations

from hybrispark.functions import thermo
from hybrispark.functions.seqfn import DINUCLEOTIDES
from hybrispark.functions.thermo import Conditions
from hybrispark.operators.annotation import ID_RULES
from hybrispark.operators.duplex import DISCRIMINANT
from hybrispark.operators.mining import MiningConfig, config

SPACE = r"[\s\v\p{Z}\x1c-\x1f\x{85}]"
SEQUENCES = f"""s AS (
    SELECT * FROM (
        SELECT 'm' || mine_id AS seq_id, max(upper(regexp_replace(seq, '{SPACE}', '', 'g'))) AS seq
        FROM mine_probes WHERE mine_id IS NOT NULL AND seq IS NOT NULL GROUP BY 1
    ) WHERE seq <> ''
)"""
PROBES = f"""p AS (
    SELECT DISTINCT probe_id, seqid, seq_id, "start", "stop", upper(regexp_replace(probe_seq, '{SPACE}', '', 'g')) AS probe_seq, tm, max_kmer
    FROM test_probes WHERE probe_id IS NOT NULL
)"""


def _case(word: str, values: dict[str, int]) -> str:
    return f"CASE {word} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0 END"


ENDS_H = {b: t[0] for b, t in thermo.TERMINAL.items()}
ENDS_S = {b: t[1] for b, t in thermo.TERMINAL.items()}


def turned(x: str) -> str:
    return f"reverse(translate({x}, 'ACGTacgt', 'TGCAtgca'))"


def energy(seq: str) -> tuple[str, str]:
    out = []
    for values, ends in ((thermo.ENTHALPY, ENDS_H), (thermo.ENTROPY, ENDS_S)):
        inner = f"coalesce(list_sum(list_transform(range(1, length({seq})), lambda i: {_case(f'substr({seq}, i, 2)', values)})), 0)"
        out.append(f"({inner} + {_case(f'substr({seq}, 1, 1)', ends)} + {_case(f'substr({seq}, length({seq}), 1)', ends)})")
    return out[0], out[1]


def probe_tm(c: Conditions) -> str:
    h, s = energy("probe_seq")
    value = f"({h} / 10 * 1000) / ({s} / 10 + {thermo.SALT_FACTOR} * (length(probe_seq) - 1) * ln({c.monovalent!r} / 1000) + {c.strand_term!r}) - {thermo.KELVIN} - {c.depression!r}"
    return f"WITH {PROBES} SELECT probe_id, CASE WHEN regexp_full_match(probe_seq, '[ACGT]{{2,}}') THEN round({value}, 4) END AS tm FROM p"


def _free(temperature: float, c: Conditions) -> str:
    h, s = energy("probe_seq")
    return f"({h} / 10 - ({thermo.KELVIN} + {temperature}) * ({s} / 10 + {thermo.SALT_FACTOR} * (length(probe_seq) - 1) * ln({c.monovalent!r} / 1000)) / 1000)"


def pdup() -> str:
    rt = thermo.GAS_CONSTANT / 1000 * (thermo.KELVIN + 60.0)
    g = _free(60.0, Conditions(pct_formamide=0))
    a, b = 1e-6, 1e-12
    return f"""WITH {PROBES}, g AS (SELECT probe_id, probe_seq, CASE WHEN regexp_full_match(probe_seq, '[ACGT]{{2,}}') THEN exp({g} / {rt!r}) END AS k FROM p),
        x AS (SELECT *, {a + b!r} + k AS x FROM g)
        SELECT probe_id, CASE WHEN x IS NOT NULL THEN round(least({2 * a * b!r} / (x + sqrt(x * x - {4 * a * b!r})) / {b!r}, 1.0), 6) END AS pdup FROM x"""


def pdup_strands(conc_a: float, conc_b: float, temperature: float, names: tuple[str, ...], share: float) -> str:
    """The closed form for a probe and its reverse complement, divided among equal competitors."""
    rt = thermo.GAS_CONSTANT / 1000 * (thermo.KELVIN + temperature)
    cols = ", ".join(f"CASE WHEN x IS NOT NULL THEN round(least({2 * conc_a * conc_b!r} / (x + sqrt(x * x - {4 * conc_a * conc_b!r})) / {conc_b!r}, 1.0) * {share}, 6) END AS {n}" for n in names)
    return f"""WITH {PROBES}, g AS (SELECT probe_id, CASE WHEN regexp_full_match(probe_seq, '[ACGT]{{2,}}') THEN exp({_free(temperature, Conditions(pct_formamide=0))} / {rt!r}) END AS k FROM p),
        x AS (SELECT *, {conc_a + conc_b!r} + k AS x FROM g) SELECT probe_id, {cols} FROM x"""


def pdup_competitive() -> str:
    rt = thermo.GAS_CONSTANT / 1000 * (thermo.KELVIN + 60.0)
    g = _free(60.0, Conditions(pct_formamide=0))
    return f"""WITH {PROBES}, g AS (SELECT probe_id, CASE WHEN regexp_full_match(probe_seq, '[ACGT]{{2,}}') THEN {g} END AS g FROM p),
        x AS (SELECT probe_id, 1e-6 * exp(-g / {rt!r}) AS a, 1e-6 * exp(-(g + 6.0) / {rt!r}) AS b FROM g)
        SELECT probe_id, round(a / (1 + a + b), 6) AS on_target, round(b / (1 + a + b), 6) AS off_target FROM x"""


def _bases(source: str, table: str) -> str:
    return f"""{source}, b0 AS (
        SELECT seq_id, length(seq) AS n, unnest(string_split(seq, '')) AS b, generate_subscripts(string_split(seq, ''), 1) - 1 AS i FROM {table}
    )"""


def windows_sql(cfg: MiningConfig, source: str = SEQUENCES, table: str = "s") -> str:
    """CTEs up to ``t``: one row a base with tm_L, ok_L and gc_L of every length."""
    r = None if cfg.max_homopolymer is None else cfg.max_homopolymer + 1
    flags = {
        "h": _case("b || lead(b) OVER w", thermo.ENTHALPY),
        "e": _case("b || lead(b) OVER w", thermo.ENTROPY),
        "bad": "CASE WHEN b IN ('A', 'C', 'G', 'T') THEN 0 ELSE 1 END",
        "gc": "CASE WHEN b IN ('G', 'C') THEN 1 ELSE 0 END",
    }
    widths = {}
    if r:
        widths["run"] = r
        flags["run"] = f"CASE WHEN {' AND '.join(f'b = lead(b, {d}) OVER w' for d in range(1, r))} THEN 1 ELSE 0 END"
    for k, m in enumerate(cfg.motifs):
        widths[f"m{k}"] = len(m)
        flags[f"m{k}"] = f"CASE WHEN {' AND '.join(f'lead(b, {d}) OVER w = {c!r}' for d, c in enumerate(m))} THEN 1 ELSE 0 END"
    c = cfg.conditions
    cols = []
    for size in range(cfg.min_length, cfg.max_length + 1):
        ahead = lambda k, d: f"(lead(c_{k}, {d}) OVER w - c_{k})"
        whole = lambda k, d: f"(lead(c_{k}, {d}) OVER w - c_{k} + {k})"
        # Sums here include the row itself: pairs of the first size-1 rows, flags of all.
        h = f"({ahead('h', size - 2)} + h + {_case('b', ENDS_H)} + {_case(f'lead(b, {size - 1}) OVER w', ENDS_H)})"
        e = f"({ahead('e', size - 2)} + e + {_case('b', ENDS_S)} + {_case(f'lead(b, {size - 1}) OVER w', ENDS_S)})"
        cols.append(f"({h} / 10 * 1000) / ({e} / 10 + {c.salt_term(size)!r} + {c.strand_term!r}) - {thermo.KELVIN} - {c.depression!r} AS tm_{size}")
        clean = [f"{whole('bad', size - 1)} = 0"] + [f"{whole(k, size - width)} = 0" for k, width in widths.items() if width <= size]
        cols.append(f"({' AND '.join(clean)}) AS ok_{size}")
        cols.append(f"{whole('gc', size - 1)} / {size} * 100 AS gc_{size}")
    sums = ", ".join(f"sum({k}) OVER (PARTITION BY seq_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS c_{k}" for k in flags)
    window = "WINDOW w AS (PARTITION BY seq_id ORDER BY i)"
    return f"""{_bases(source, table)},
    f AS (SELECT seq_id, n, i, b, {', '.join(f'{v} AS {k}' for k, v in flags.items())} FROM b0 {window}),
    c AS (SELECT *, {sums} FROM f),
    t AS (SELECT seq_id, n, i, {', '.join(cols)} FROM c {window})"""


def mining_sql(source: str = SEQUENCES, table: str = "s", **settings) -> str:
    cfg = config(**settings)
    sizes = range(cfg.min_length, cfg.max_length + 1)
    allowed = lambda z: f"(ok_{z} AND tm_{z} >= {cfg.min_tm} AND tm_{z} <= {cfg.max_tm})"
    rows = "\nUNION ALL\n".join(
        f"SELECT seq_id, i, {z} AS z, tm_{z} AS tm, gc_{z} AS gc FROM t WHERE {allowed(z)} AND i <= n - {cfg.max_length}" for z in sizes
    )
    order = "z" if cfg.tm_target is None else f"abs(tm - {cfg.tm_target}), z"
    pick = "SELECT * FROM o" if cfg.exhaustive else f"SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY seq_id, i ORDER BY {order}) = 1"
    found = f"""{windows_sql(cfg, source, table)},
    o AS ({rows}),
    k AS ({pick}),
    r AS (
        SELECT k.seq_id, CAST(i AS INT) AS "start", CAST(i + z AS INT) AS "stop", substr(s.seq, i + 1, z) AS probe_seq, round(tm, 2) AS tm
        FROM k JOIN {table} s ON k.seq_id = s.seq_id WHERE gc >= {cfg.min_gc} - 1e-9 AND gc <= {cfg.max_gc} + 1e-9
    )"""
    if not cfg.spaced:
        return f"WITH {found} SELECT * FROM r"
    gap = max(cfg.spacing, 0)
    return f"""WITH {found},
    y AS (
        SELECT seq_id, unnest(list_reduce(
            list_prepend({{'last': -1, 'kept': []::INT[]}}, list({{'last': "stop", 'kept': ["start"]}} ORDER BY "start")),
            lambda acc, x: CASE WHEN x.kept[1] >= acc.last + {gap}
                THEN {{'last': x.last, 'kept': list_append(acc.kept, x.kept[1])}} ELSE acc END).kept) AS pos0
        FROM r GROUP BY seq_id
    )
    SELECT r.* FROM r JOIN y ON r.seq_id = y.seq_id AND r."start" = y.pos0"""


def tm_windows_sql() -> str:
    cfg = config()
    loose = config(max_homopolymer=None)
    rows = "\nUNION ALL\n".join(
        f"SELECT seq_id, {z} AS length, tm_{z} AS tm FROM t WHERE ok_{z} AND i <= n - {cfg.max_length}" for z in range(cfg.min_length, cfg.max_length + 1)
    )
    return f"""WITH {windows_sql(loose)}, o AS ({rows})
        SELECT seq_id, CAST(length AS INT) AS length, count(*) AS n_windows, round(min(tm), 3) AS min_tm, round(max(tm), 3) AS max_tm, round(avg(tm), 3) AS mean_tm
        FROM o GROUP BY seq_id, length"""


def _kmers(k: int, canonical: bool = False) -> str:
    word = f"substr(seq, i, {k})"
    return f"""{SEQUENCES}, w0 AS (
        SELECT unnest(list_transform(range(1, length(seq) - {k - 2}), lambda i: {word})) AS w FROM s WHERE length(seq) >= {k}
    ), w AS (SELECT {'least(w, ' + turned('w') + ')' if canonical else 'w'} AS kmer FROM w0 WHERE regexp_full_match(w, '[ACGT]+'))"""


def _lda() -> str:
    gc = "((length(probe_seq) - length(replace(replace(probe_seq, 'G', ''), 'C', ''))) / length(probe_seq) * 100)"
    score = "(probe_id % 60 - 5)"
    cols = [f"round(least(greatest(1 / (1 + exp(-(length(probe_seq) * {a} + {score} * {b} + {gc} * {c} + {d}))), 0), 1), 6) AS pred_{t}" for t, (a, b, c, d) in DISCRIMINANT.items()]
    return f"WITH {PROBES} SELECT probe_id, {', '.join(cols)} FROM p WHERE probe_seq <> ''"


def _features() -> str:
    cols = []
    for name, seq in (("probe", "probe_seq"), ("derived", turned("reverse(probe_seq)"))):
        cols += [f"CAST((length({seq}) - length(replace({seq}, '{d}', ''))) / 2 AS INT) AS {name}_{d.lower()}" for d in DINUCLEOTIDES]
        cols.append(f"round((length({seq}) - length(replace(replace({seq}, 'G', ''), 'C', ''))) / length({seq}) * 100, 4) AS {name}_gc_percent")
        cols.append(f"length(probe_seq) AS {name}_len")
    return f"WITH {PROBES} SELECT probe_id, CAST(probe_id % 60 - 5 AS INT) AS align_score, {', '.join(cols)} FROM p WHERE probe_seq <> ''"


_SAM = f"""{PROBES}, l AS (
    SELECT probe_id, seq_id, "start", probe_seq, length(probe_seq) AS n FROM p
    WHERE probe_seq IS NOT NULL AND seq_id IS NOT NULL AND "start" IS NOT NULL AND length(probe_seq) > 14 AND probe_id % 50 <> 0
), bed AS (
    SELECT seq_id AS align_seqid,
        CAST(greatest("start" % 400 + 1 - CASE WHEN probe_id % 3 = 0 THEN 5 ELSE 0 END - 1, 0) AS INT) AS align_start,
        CAST(greatest("start" % 400 + 1 - CASE WHEN probe_id % 3 = 0 THEN 5 ELSE 0 END + CASE probe_id % 3 WHEN 0 THEN n WHEN 1 THEN n + 4 ELSE n END - 1, 0) AS INT) AS align_stop,
        'p' || probe_id AS seqid,
        CASE WHEN probe_id % 4 = 0 THEN NULL ELSE CAST(-(probe_id % 30) AS INT) END AS align_score,
        CASE WHEN probe_id % 2 = 0 THEN '-' ELSE '+' END AS align_strand,
        CASE probe_id % 3 WHEN 0 THEN '5S' || (n - 5) || 'M' WHEN 1 THEN '10M2I' || (n - 12) || 'M1D3H' ELSE n || 'M' END AS align_cigar
    FROM l
)"""
_MERGED = f"""{PROBES}, q AS (SELECT DISTINCT seqid, seq_id, "start", "stop" FROM p WHERE seqid IS NOT NULL), a AS (
    SELECT score_id, seqid, regexp_extract(seqid, '^(.*):\\d+-\\d+$', 1) AS align_seqid,
        CAST(regexp_extract(seqid, ':(\\d+)-\\d+$', 1) AS INT) + CASE WHEN score_id % 3 = 0 THEN 7 ELSE 0 END AS align_start, on_target_score AS pred
    FROM scoring WHERE seqid IS NOT NULL AND on_target_score IS NOT NULL AND NOT isnan(on_target_score)
), m AS (
    SELECT q.*, a.score_id, a.align_seqid, CAST(a.align_start AS INT) AS align_start, a.pred,
        coalesce(a.align_seqid = q.seq_id AND a.align_start = q."start", false) AS on_target
    FROM q JOIN a ON q.seqid = a.seqid
)"""
_WHOLE = "seq_id IS NOT NULL AND probe_seq IS NOT NULL AND tm IS NOT NULL"


#: Values packed in the attributes, by one pattern for an entry and one for each form of value.
_PACKED = r"""
    pd AS (
        SELECT DISTINCT rec_id, regexp_replace(attributes, '^\s+|\s+$', '', 'g') AS a FROM gtf_io
    ), pf AS (
        SELECT rec_id, CASE WHEN a LIKE '"%' THEN replace(regexp_extract(a, '^"((?:[^"]|"")*)"?', 1), '""', '"') ELSE a END AS a FROM pd
    ), px AS (
        SELECT rec_id, regexp_extract_all(a, '\w+(?: *= *| +)?(?:"(?:[^"]|"")*"?|''[^'']*''?|[^;；|\t\n\r"''][^;；|\t\n\r]*)?') AS es FROM pf
    ), pe AS (
        SELECT rec_id, unnest(es) AS entry, generate_subscripts(es, 1) AS i FROM px
    ), pq AS (
        SELECT rec_id, i, regexp_extract(entry, '^\w+') AS attr_key,
            regexp_replace(regexp_replace(entry, '^\w+(?: *= *| +)?', ''), '\s+$', '') AS v FROM pe
    ), pv AS (
        SELECT rec_id, i, attr_key, CASE
            WHEN v LIKE '"%' THEN [replace(regexp_extract(v, '^"((?:[^"]|"")*)"?', 1), '""', '"')]
            WHEN v LIKE '''%' THEN [regexp_extract(v, '^''([^'']*)''?', 1)]
            ELSE list_transform(string_split(v, ','), lambda w: regexp_replace(w, '^\s+|\s+$', '', 'g')) END AS vs,
            CASE WHEN v LIKE '"%' AND NOT regexp_full_match(v, '"(?:[^"]|"")*"') OR v LIKE '''%' AND NOT regexp_full_match(v, '''[^'']*''')
                THEN 'open_quote' END AS error
        FROM pq
    ), pu AS (
        SELECT rec_id, i, attr_key, error, unnest(vs) AS attr_value, generate_subscripts(vs, 1) AS j FROM pv
    ), pk AS (
        SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY i, j) AS INT) AS pos, attr_key, attr_value, error FROM pu
    )"""
PACKED = f"WITH {_PACKED} SELECT rec_id, pos, attr_key, attr_value FROM pk"
PACKED_ERRORS = f"WITH {_PACKED} SELECT rec_id, pos, attr_key, attr_value, error FROM pk"

def _last(key: str) -> str:
    """The last value of a key in a field."""
    return f"coalesce(arg_max(attr_value, pos) FILTER (attr_key = '{key}'), '')"


_ATTRIBUTES = f"""{_PACKED}, ka AS (
    SELECT rec_id, {_last('gene_id')} AS gene_id, {_last('gene_name')} AS gene_name, {_last('transcript_id')} AS transcript_id, {_last('Parent')} AS parent
    FROM pk GROUP BY rec_id
)"""
_EXONS = f"""{_ATTRIBUTES}, g0 AS (
    SELECT DISTINCT rec_id, seqid, "type", "start", "end", score, strand FROM gtf_io WHERE rec_id IS NOT NULL AND attributes IS NOT NULL
), ex AS (
    SELECT rec_id, seqid, "start", "end", strand, score, gene_id, CASE WHEN transcript_id <> '' THEN transcript_id ELSE parent END AS transcript_id_full
    FROM g0 JOIN ka USING (rec_id)
    WHERE lower(trim("type", ' ')) = 'exon' AND "start" < "end" AND strand IN ('+', '-')
        AND split_part(CASE WHEN transcript_id <> '' THEN transcript_id ELSE parent END, '.', 1) <> ''
)"""
_NUMBERED = f"""{SEQUENCES}, sn AS (
    SELECT row_number() OVER o - 1 AS no, seq_id, seq, length(seq) AS size,
        sum(length(seq) + 1) OVER (ORDER BY CAST(substr(seq_id, 2) AS BIGINT) ROWS UNBOUNDED PRECEDING) - length(seq) - 1 AS at,
        count(*) OVER () AS n, sum(length(seq) + 1) OVER () AS total
    FROM s WINDOW o AS (ORDER BY CAST(substr(seq_id, 2) AS BIGINT))
)"""
#: All sequences, shared out among the names of the annotation in order and joined by an N.
_GENOME = f"""{_NUMBERED}, nm AS (
    SELECT seqid, row_number() OVER (ORDER BY seqid) - 1 AS r, count(*) OVER () AS names FROM (SELECT DISTINCT seqid FROM gtf_io WHERE seqid IS NOT NULL)
), tt AS (SELECT max(n) AS n, max(total) AS total FROM sn), lg AS (
    SELECT coalesce(max("end" - "start"), 0) AS longest FROM gtf_io WHERE lower(trim("type", ' ')) = 'exon' AND "start" < "end"
), n1 AS (
    SELECT seqid, n, total, r * n // names AS first, greatest(r * n // names, (r + 1) * n // names - 1) AS own, longest FROM nm, tt, lg
), n2 AS (
    SELECT n1.*, sn.at + longest + 1 AS reach FROM n1 JOIN sn ON sn.no = first
), n3 AS (
    SELECT n2.*, greatest(own, (SELECT max(no) FROM sn WHERE sn.at <= reach % total) + reach // total * n2.n) AS last FROM n2
), gi AS (
    SELECT seqid, n, unnest(range(CAST(first AS BIGINT), CAST(last + 1 AS BIGINT))) AS i FROM n3
), gn AS (
    SELECT seqid AS seq_id, string_agg(seq, 'N' ORDER BY i) AS seq FROM gi JOIN sn ON sn.no = i % gi.n GROUP BY seqid
)"""


def _local(rows: str) -> str:
    """Rows moved to a start that lets them end within the genome made of all sequences."""
    return f"""SELECT {rows}.* REPLACE (
        CAST({rows}."start" % greatest(length(gn.seq) - ({rows}."end" - {rows}."start"), 1) AS INT) AS "start",
        CAST({rows}."start" % greatest(length(gn.seq) - ({rows}."end" - {rows}."start"), 1) + {rows}."end" - {rows}."start" AS INT) AS "end")
        FROM {rows} JOIN gn ON gn.seq_id = {rows}.seqid"""


#: Exons as whole as they are, moved into that genome.
_LOCAL = f"""lo AS (SELECT DISTINCT transcript_id_full, seqid, "start", "end", strand FROM ({_local('ex')}))"""
_TRIM = f"""{_NUMBERED}, {PROBES}, iv AS (
    SELECT probe_id, sn.seq_id AS align_seqid, "start" * 3 - 40 AS a, "stop" * 3 + 40 AS b,
        CASE WHEN probe_id % 2 = 0 THEN '-' ELSE '+' END AS align_strand, seq
    FROM p JOIN sn ON sn.no = ((probe_id % sn.n) + sn.n) % sn.n WHERE "start" IS NOT NULL AND "stop" IS NOT NULL
), tr AS (
    SELECT probe_id, align_seqid, CAST(greatest(0, least(a, length(seq))) AS INT) AS align_start,
        CAST(greatest(0, least(b, length(seq))) AS INT) AS align_stop, align_strand, seq
    FROM iv
)"""
_PART = "CASE WHEN {strand} = '-' THEN " + turned("substr(seq, {a} + 1, {b} - {a})") + " ELSE substr(seq, {a} + 1, {b} - {a}) END"


def _part(prefix: str = "") -> str:
    return _PART.format(strand=f"{prefix}strand", a=f'greatest({prefix}"start", 0)', b=f'{prefix}"end"')


_LABEL = """seqid || ':' || "start" || '-' || "end" || '(' || strand || ')'"""
_FLAT = f"""{_EXONS}, ge AS (SELECT * FROM ex WHERE gene_id <> ''), st AS (
    SELECT gene_id, pos0, sum(d) AS d FROM (
        SELECT gene_id, "start" AS pos0, 1 AS d FROM ge UNION ALL SELECT gene_id, "end", -1 FROM ge
    ) GROUP BY gene_id, pos0 HAVING sum(d) <> 0
), lv AS (
    SELECT gene_id, pos0, sum(d) OVER (PARTITION BY gene_id ORDER BY pos0 ROWS UNBOUNDED PRECEDING) AS cov, lead(pos0) OVER (PARTITION BY gene_id ORDER BY pos0) AS nx FROM st
), tp AS (SELECT gene_id, max(cov) AS top FROM lv GROUP BY gene_id), fr AS (
    SELECT gene_id, arg_min(seqid, rec_id) AS seqid, arg_min(strand, rec_id) AS strand FROM ge GROUP BY gene_id
), nth AS (SELECT gene_id, strand, row_number() OVER (PARTITION BY gene_id ORDER BY rec_id) AS n FROM ge), sh AS (
    SELECT lv.gene_id, pos0 AS "start", nx AS "end", top, row_number() OVER (PARTITION BY lv.gene_id ORDER BY pos0) AS n
    FROM lv JOIN tp ON lv.gene_id = tp.gene_id WHERE cov = top AND nx IS NOT NULL AND top > 1
), fl AS (
    SELECT fr.seqid, CAST(sh."start" AS INT) AS "start", CAST(sh."end" AS INT) AS "end", sh.gene_id, coalesce(nth.strand, fr.strand) AS strand, CAST(top AS INT) AS coverage
    FROM sh JOIN fr ON sh.gene_id = fr.gene_id LEFT JOIN nth ON sh.gene_id = nth.gene_id AND sh.n = nth.n
    UNION ALL
    SELECT fr.seqid, ge."start", ge."end", ge.gene_id, ge.strand, 1 FROM ge JOIN tp ON ge.gene_id = tp.gene_id JOIN fr ON ge.gene_id = fr.gene_id WHERE top = 1
)"""


def _set(n: int) -> str:
    """The set of sequences by rule, numbered from 0."""
    return f"""(SELECT k AS i, 's' || (k + 1) AS id,
        list_reduce(list_transform(range(0, 8), lambda j: substr('ACGT', CAST((k * 7 + j * (k % 5 + 1)) % 4 AS INT) + 1, 1)), lambda x, y: x || y) AS seq
        FROM range({n}) r(k))"""


_TARGETS = f"""{PROBES}, tg AS (
    SELECT probe_id AS probe_ord, seq_id AS target, probe_seq FROM p
), nu AS (
    SELECT target, row_number() OVER (ORDER BY min(probe_ord)) - 1 AS no FROM tg GROUP BY target
), tn AS (
    SELECT tg.*, nu.no, row_number() OVER (PARTITION BY tg.target ORDER BY probe_ord) - 1 AS rn FROM tg LEFT JOIN nu ON tg.target = nu.target
)"""


def _placements(probes: str, local: bool, k: int | None) -> str:
    """CTEs up to ``al``: placements that share a seed of 20 with a probe of the CTE ``probes`` (q), scored letter by letter."""
    score = (
        "list_reduce(list_prepend({'here': 0, 'best': 0}, list_transform(same, lambda x: {'here': x, 'best': 0})), "
        "lambda a, x: {'here': greatest(0, a.here + CASE WHEN x.here = 1 THEN 2 ELSE -6 END), 'best': greatest(a.best, a.here + CASE WHEN x.here = 1 THEN 2 ELSE -6 END)}).best"
        if local
        else "-6 * (length(q) - list_sum(same))"
    )
    least = "20 + 8 * ln(length(q))" if local else "-0.6 - 0.6 * length(q)"
    top = f"QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, seq_id, pos0, strand) <= {k}" if k else ""
    return f"""
    sd AS (
        SELECT q, strand, i, substr(x, i + 1, 20) AS seed FROM (
            SELECT q, '+' AS strand, q AS x, unnest(range(0, length(q) - 19)) AS i FROM {probes}
            UNION ALL SELECT q, '-', {turned('q')}, unnest(range(0, length(q) - 19)) FROM {probes})
    ),
    gx AS (
        SELECT seq_id, i - 1 AS pos, w AS seed FROM (
            SELECT seq_id, unnest(range(1, length(seq) - 18)) AS i, unnest(list_transform(range(1, length(seq) - 18), lambda i: substr(seq, i, 20))) AS w
            FROM s WHERE length(seq) >= 20) WHERE regexp_full_match(w, '[ACGT]+')
    ),
    pl AS (SELECT DISTINCT q, strand, gx.seq_id, pos - i AS pos0 FROM sd JOIN gx ON sd.seed = gx.seed WHERE pos >= i),
    wn AS (
        SELECT q, strand, pl.seq_id, pos0, CASE WHEN strand = '-' THEN {turned('substr(seq, pos0 + 1, length(q))')} ELSE substr(seq, pos0 + 1, length(q)) END AS derived
        FROM pl JOIN s ON pl.seq_id = s.seq_id WHERE pos0 + length(q) <= length(seq)
    ),
    ss AS (
        SELECT *, CASE WHEN q = derived THEN [1 for x in range(length(q))] ELSE list_transform(range(1, length(q) + 1), lambda i: CASE WHEN substr(q, i, 1) = substr(derived, i, 1) THEN 1 ELSE 0 END) END AS same FROM wn
    ),
    sc AS (SELECT *, CAST({score} AS INT) AS score FROM ss),
    al AS (SELECT * FROM sc WHERE score >= {least} {top})"""


def _align_sql(local: bool) -> str:
    """All distinct sequences of test_probes and of the probes mined by default, aligned to the sequences."""
    base = "substr(q, 25, 1)"
    probe = f"substr(q, 1, 24) || {turned(base)} || substr(q, 26)" if local else "q"
    more = ", derived AS derived_seq" if local else ""
    return f"""{mining_sql().removesuffix(' SELECT * FROM r')}, {PROBES},
    pa AS (SELECT probe_seq AS q FROM p WHERE probe_seq IS NOT NULL UNION SELECT probe_seq FROM r),
    pr AS (SELECT DISTINCT {probe} AS q FROM pa),
    {_placements('pr', local, 3 if local else None)}
    SELECT q AS probe_seq, seq_id AS align_seqid, CAST(pos0 AS INT) AS align_start, CAST(pos0 + length(q) AS INT) AS align_stop, strand AS align_strand,
        score AS align_score, CAST(length(q) - list_sum(same) AS INT) AS mismatches{more}
    FROM al"""


def _flagship_sql() -> str:
    """Probes mined by default with their highest word count and the sums of their predictions at and off the target."""
    a, b, c, d = DISCRIMINANT[42]
    gc = "((length(q) - length(replace(replace(q, 'G', ''), 'C', ''))) / length(q) * 100)"
    words = "unnest(list_transform(range(1, length({x}) - 16), lambda i: substr({x}, i, 18)))"
    return f"""{mining_sql().removesuffix(' SELECT * FROM r')},
    pr AS (SELECT DISTINCT probe_seq AS q FROM r),
    kc AS (SELECT kmer, count(*) AS cnt FROM (SELECT {words.format(x='seq')} AS kmer FROM s WHERE length(seq) >= 18) WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY kmer),
    mk AS (SELECT q, max(coalesce(cnt, 0)) AS m FROM (SELECT DISTINCT q, {words.format(x='q')} AS kmer FROM pr) LEFT JOIN kc USING (kmer) GROUP BY q),
    {_placements('pr', True, 100)},
    pd AS (SELECT q, seq_id, pos0, least(greatest(1 / (1 + exp(-(length(q) * {a} + score * {b} + {gc} * {c} + {d}))), 0), 1) AS pred FROM al),
    sm AS (
        SELECT r.seq_id || ':' || "start" || '-' || "stop" AS seqid, sum(CASE WHEN pd.seq_id = r.seq_id AND pos0 = "start" THEN pred END) AS on_score,
            sum(CASE WHEN NOT (pd.seq_id = r.seq_id AND pos0 = "start") THEN pred END) AS off_score
        FROM r JOIN pd ON r.probe_seq = pd.q GROUP BY 1
    )
    SELECT r.seq_id || ':' || "start" || '-' || "stop" AS seqid, probe_seq, tm, CAST(m AS INT) AS max_kmer,
        CASE WHEN sm.seqid IS NOT NULL THEN round(coalesce(on_score, 0.0), 6) END AS on_target_score,
        CASE WHEN sm.seqid IS NOT NULL THEN round(coalesce(off_score, 0.0), 6) END AS off_target_score
    FROM r LEFT JOIN mk ON mk.q = r.probe_seq LEFT JOIN sm ON sm.seqid = r.seq_id || ':' || "start" || '-' || "stop"
    """


def _mine_flattened_sql() -> str:
    """Probes of all shared stretches, whole and within the genome made of all sequences."""
    source = f"""{_FLAT}, {_GENOME}, fm AS (SELECT DISTINCT seqid, "start", "end", strand FROM ({_local('fl')})), fs AS (
        SELECT {_LABEL} AS seq_id, {_part()} AS seq FROM fm JOIN gn ON fm.seqid = gn.seq_id
    )"""
    mined = mining_sql(source=source, table="fs").removesuffix(" SELECT * FROM r")
    return f"""{mined} SELECT *, seq_id || ':' || "start" || '-' || "stop" AS seqid FROM r"""


def build(mining: dict[str, dict], size: int, strands: tuple[float, float, float]) -> dict[str, str]:
    """The SQL of every core query that SQL can express on whole tables."""
    kinds = " ".join(f"WHEN regexp_matches(seq_id, '{p}') THEN '{n}'" for n, p in ID_RULES.items())
    entry = "coalesce(e.id || '_' || e.seq, '')"
    joined = lambda left: "e.seq || 'TTT' || probe_seq" if left else "probe_seq || 'TTT' || e.seq"
    out = {
        "dna_scan": f"WITH {SEQUENCES} SELECT * FROM s",
        "chrom_sizes": f"WITH {SEQUENCES} SELECT seq_id, CAST(length(seq) AS INT) AS size FROM s ORDER BY size DESC, seq_id",
        "rev_comp": f"WITH {PROBES} SELECT probe_id, {turned('probe_seq')} AS rc FROM p",
        "gc_content": f"""WITH {PROBES}, x AS (SELECT probe_id, CASE WHEN probe_seq = '' THEN 0.0
            ELSE (length(probe_seq) - length(replace(replace(probe_seq, 'G', ''), 'C', ''))) / length(probe_seq) END AS gc FROM p)
            SELECT probe_id, round(gc, 6) AS gc, round(gc * 100, 4) AS gc_percent FROM x""",
        "clamp_values": f"WITH {PROBES} SELECT probe_id, CASE WHEN isnan(tm) THEN tm ELSE CASE WHEN tm < 30 THEN 30.0 WHEN tm > 42.5 THEN 42.5 ELSE tm END END AS tm FROM p",
        "kmer_words": f"""WITH {PROBES} SELECT probe_id, CAST(i - 1 AS INT) AS pos, substr(probe_seq, i, 12) AS kmer
            FROM (SELECT probe_id, probe_seq, unnest(range(1, length(probe_seq) - 10)) AS i FROM p WHERE length(probe_seq) >= 12)""",
        "interval_labels": f"""WITH {_EXONS} SELECT DISTINCT {_LABEL} AS label, seqid, "start", "end" AS "stop", strand FROM ex""",
        "local_to_genomic": f"""WITH {_EXONS} SELECT DISTINCT {_LABEL} AS label, seqid,
            CASE WHEN strand = '-' THEN "end" - 33 ELSE "start" + 3 END AS "start", CASE WHEN strand = '-' THEN "end" - 3 ELSE "start" + 33 END AS "stop" FROM ex""",
        "probe_tm": probe_tm(Conditions()),
        "probe_tm_salt": probe_tm(Conditions(Na=50, K=10, Tris=10, Mg=3, dNTPs=1, pct_formamide=0)),
        "pdup_two_state": pdup(),
        "pdup_competitive": pdup_competitive(),
        "tm_windows": tm_windows_sql(),
        "kmer_count": f"WITH {_kmers(18)} SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer",
        "kmer_canonical": f"WITH {_kmers(11, True)} SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer HAVING count(*) >= 2",
        "kmer_query": f"""WITH {_kmers(11)}, {PROBES}, ix AS (SELECT kmer, count(*) AS cnt FROM w GROUP BY kmer),
            pw AS (SELECT probe_id, unnest(list_transform(range(1, length(probe_seq) - 9), lambda i: substr(probe_seq, i, 11))) AS kmer FROM p WHERE length(probe_seq) >= 11)
            SELECT probe_id, pw.kmer, coalesce(cnt, 0) AS cnt FROM pw LEFT JOIN ix ON pw.kmer = ix.kmer""",
        "max_kmer": f"""WITH {PROBES}, w AS (
                SELECT probe_id, probe_seq, unnest(list_transform(range(1, length(probe_seq) - 16), lambda i: substr(probe_seq, i, 18))) AS kmer FROM p WHERE length(probe_seq) >= 18
            ), ix AS (SELECT kmer, count(*) AS cnt FROM w WHERE regexp_full_match(kmer, '[ACGT]+') GROUP BY kmer),
            mx AS (SELECT probe_seq, max(coalesce(cnt, 0)) AS m FROM (SELECT DISTINCT probe_seq, kmer FROM w) d LEFT JOIN ix ON d.kmer = ix.kmer GROUP BY probe_seq)
            SELECT probe_id, CAST(m AS DOUBLE) AS max_kmer FROM p LEFT JOIN mx ON p.probe_seq = mx.probe_seq""",
        "sam_to_bed": f"WITH {_SAM} SELECT * REPLACE (CAST(align_score AS DOUBLE) AS align_score) FROM bed",
        "bed_text": f"""WITH {_SAM} SELECT concat_ws(chr(9), align_seqid, align_start, align_stop, seqid, coalesce(CAST(align_score AS VARCHAR), 'NA'), align_strand, align_cigar) AS value FROM bed""",
        "trim_coords": f"WITH {_TRIM} SELECT probe_id, align_seqid, align_start, align_stop, align_strand FROM tr",
        "fetch_seq": f"""WITH {_TRIM} SELECT DISTINCT probe_id, align_seqid, align_start, align_stop, align_strand,
            CASE WHEN align_strand = '-' THEN {turned('substr(seq, align_start + 1, align_stop - align_start)')} ELSE substr(seq, align_start + 1, align_stop - align_start) END AS derived_seq
            FROM tr WHERE align_start < align_stop""",
        "align_topk": _align_sql(True),
        "align_end_to_end": _align_sql(False),
        "merge_probes": f"WITH {_MERGED} SELECT * EXCLUDE (pred) FROM m",
        "score_probes": f"""WITH {_MERGED} SELECT seqid, round(coalesce(sum(pred) FILTER (on_target), 0.0), 6) AS on_target_score,
            round(coalesce(sum(pred) FILTER (NOT on_target), 0.0), 6) AS off_target_score FROM m GROUP BY seqid""",
        "lda_predict": _lda(),
        "xgb_features": _features(),
        "probe_bed_text": f"""WITH {PROBES} SELECT concat_ws(chr(9), seq_id, "start", "stop", probe_seq, printf('%.2f', tm)) AS value FROM p WHERE {_WHOLE}""",
        "probe_fastq_text": f"""WITH {PROBES} SELECT '@' || seq_id || ':' || "start" || '-' || "stop" || chr(10) || probe_seq || chr(10) || '+' || chr(10) || repeat('~', length(probe_seq)) AS value FROM p WHERE {_WHOLE}""",
        "probe_csv_text": f"""WITH {PROBES} SELECT concat_ws(',', seq_id, "start", "stop", probe_seq, printf('%.2f', tm)) AS value FROM p WHERE {_WHOLE}""",
        "fasta_text": f"""WITH {PROBES}, x AS (SELECT probe_id, probe_seq || probe_seq AS q FROM p WHERE {_WHOLE} AND probe_seq <> '')
            SELECT '>' || probe_id || chr(10) || substr(q, 1, 60) || CASE WHEN length(q) > 60 THEN chr(10) || substr(q, 61, 60) ELSE '' END AS value FROM x""",
        "gtf_attributes": f"""WITH {_ATTRIBUTES}, d AS (SELECT DISTINCT rec_id, attributes FROM gtf_io WHERE rec_id IS NOT NULL)
            SELECT rec_id, coalesce(gene_id, '') AS gene_id, coalesce(gene_name, '') AS gene_name, coalesce(transcript_id, '') AS transcript_id_full,
                split_part(coalesce(transcript_id, ''), '.', 1) AS transcript_id FROM d LEFT JOIN ka USING (rec_id)""",
        "gtf_filter": """SELECT DISTINCT rec_id, seqid, "start", "end" FROM gtf_io WHERE "type" = 'exon' AND regexp_matches(seqid, '^chr') AND NOT regexp_matches(seqid, 'X') AND "start" IS NOT NULL AND "end" IS NOT NULL""",
        "classify_ids": f"SELECT DISTINCT seq_id, CASE {kinds} ELSE 'canonical' END AS class FROM test_probes WHERE seq_id IS NOT NULL",
        "filter_ids": r"SELECT DISTINCT seq_id FROM test_probes WHERE regexp_matches(seq_id, 'chr|ctg') AND NOT regexp_matches(seq_id, '\(-\)')",
        "exon_seqs": f"""WITH {_EXONS}, {_GENOME}, {_LOCAL}, d AS (SELECT DISTINCT seqid, "start", "end", strand FROM lo)
            SELECT {_LABEL} AS label, {_part()} AS sequence FROM d JOIN gn ON d.seqid = gn.seq_id WHERE "start" < length(seq)""",
        "introns": f"""WITH {_EXONS}, x AS (
                SELECT transcript_id_full, seqid, "end" AS "start", lead("start") OVER (PARTITION BY transcript_id_full, seqid, strand ORDER BY "start", "end") AS e, strand FROM ex
            ) SELECT transcript_id_full, seqid, "start", e AS "end", strand FROM x WHERE "start" < e""",
        "spliced_seq": f"""WITH {_EXONS}, {_GENOME}, {_LOCAL}, d AS (SELECT * FROM lo)
            SELECT transcript_id_full, string_agg({_part()}, '' ORDER BY CASE WHEN strand = '+' THEN "start" ELSE -"start" END, "end", {_part()}) AS sequence
            FROM d JOIN gn ON d.seqid = gn.seq_id WHERE "start" < length(seq) GROUP BY transcript_id_full""",
        "mine_flattened": _mine_flattened_sql(),
        "pipeline_flagship": _flagship_sql(),
        "p2_values": PACKED_ERRORS,
        "flatten_isoforms": f"WITH {_FLAT} SELECT * FROM fl",
        "append_same": f"""WITH {_TARGETS} SELECT probe_ord, {joined(True)} AS sequence, e.id || '_' || e.seq AS entry FROM tg CROSS JOIN {_set(1)} e""",
        "append_unique": f"""WITH {_TARGETS} SELECT probe_ord, CASE WHEN e.id IS NULL THEN probe_seq ELSE {turned('e.seq')} || 'TTT' || probe_seq END AS sequence, {entry} AS entry FROM tn LEFT JOIN {_set(size)} e ON e.i = no""",
        "append_multiple": f"""WITH {_TARGETS} SELECT probe_ord, CASE WHEN e.id IS NULL THEN probe_seq ELSE {joined(False)} END AS sequence, {entry} AS entry FROM tn LEFT JOIN {_set(3 * size)} e ON e.i = no * 3 + rn % 3""",
        "append_custom": f"""WITH {_TARGETS}, a AS (SELECT max(CASE i WHEN 0 THEN seq END) AS s0, max(CASE i WHEN 1 THEN seq END) AS s1, max(CASE i WHEN 2 THEN seq END) AS s2 FROM {_set(3)})
            SELECT probe_ord, CASE WHEN probe_ord BETWEEN 120 AND 150 THEN s2 || 'TTT' ELSE '' END || CASE WHEN probe_ord BETWEEN 40 AND 90 THEN s1 || 'TTT' ELSE '' END
                || CASE WHEN probe_ord BETWEEN 1 AND 50 THEN s0 || 'TTT' ELSE '' END || probe_seq AS sequence,
                CASE WHEN probe_ord BETWEEN 120 AND 150 THEN 's3_' || s2 WHEN probe_ord BETWEEN 40 AND 90 THEN 's2_' || s1 WHEN probe_ord BETWEEN 1 AND 50 THEN 's1_' || s0 ELSE '' END AS entry
            FROM tg CROSS JOIN a""",
        "append_saber": f"""WITH {_TARGETS} SELECT probe_ord, CASE WHEN e.id IS NULL THEN probe_seq ELSE {joined(False)} END AS sequence, {entry} AS entry FROM tn LEFT JOIN {_set(size)} e ON e.i = no""",
        "master_table": f"""WITH {_TARGETS}, o AS (SELECT id || '_' || seq AS entry FROM {_set(1)})
            SELECT probe_ord, o.entry AS "outer", {entry} AS "inner" FROM tn LEFT JOIN {_set(size)} e ON e.i = no CROSS JOIN o""",
        "pdup_strands": pdup_strands(*strands, ("pdup",), 1.0),
        "pdup_competing": pdup_strands(*strands, ("a_target", "b_target"), 0.5),
    }
    return out | {name: mining_sql(**settings) for name, settings in mining.items()}
