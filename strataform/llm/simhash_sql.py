"""DuckDB SQL of op2: XXH64 in 128-bit integers, fingerprints by bit counts, links by all pairs of distinct fingerprints.

It is a check on small tables; the operator itself is in ``simhash``.
"""

from __future__ import annotations

from .simhash import _P1, _P2, _P3, _P4, _P5, SEED, SHINGLE, THRESHOLD

_TOP = f"{1 << 64}::UHUGEINT"
_MULTIPLY = {i: f"{int(p)}::UHUGEINT" for i, p in enumerate((_P1, _P2, _P3, _P4, _P5), 1)}


def _mul(x: str, prime: int) -> str:
    return f"(({x}) * {_MULTIPLY[prime]} % {_TOP})"


def _add(x: str, y: str) -> str:
    return f"((({x}) + {y}) % {_TOP})"


def _rot(x: str, k: int) -> str:
    return f"((({x}) * {1 << k}::UHUGEINT) % {_TOP} + ({x}) // {1 << (64 - k)}::UHUGEINT)"


def _number(at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes from byte ``at`` of the hex text x."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size))) + ")::UHUGEINT"


def _round(acc: str, lane: str) -> str:
    return _mul(_rot(_add(acc, _mul(lane, 2)), 31), 1)


def _shift(x: str, k: int) -> str:
    return f"xor({x}, ({x}) // {1 << k}::UHUGEINT)"


_STARTS = [(SEED + int(_P1) + int(_P2)) % (1 << 64), (SEED + int(_P2)) % (1 << 64), SEED, (SEED - int(_P1)) % (1 << 64)]
_LANES_OF = ", ".join(
    f"list_reduce(list_concat([{start}::UHUGEINT], list_transform(range(0, n // 32), lambda i: lanes[4 * i + {j + 1}])), lambda a, lane: {_round('a', 'lane')}) AS v{j}" for j, start in enumerate(_STARTS)
)
_SUM = " + ".join(_rot(f"v{j}", k) for j, k in enumerate((1, 7, 12, 18)))
_MERGE = f"list_reduce(list_concat([({_SUM}) % {_TOP}], [{', '.join(_round('0::UHUGEINT', f'v{j}') for j in range(4))}]), lambda a, v: {_add(_mul('xor(a, v)', 1), _MULTIPLY[4])})"

SIMHASH_SQL = f"""
    WITH RECURSIVE docs AS MATERIALIZED (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    shingles AS MATERIALIZED (
        SELECT r, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))
                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g
        FROM docs),
    spans AS MATERIALIZED (SELECT g, strlen(g) AS n, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM shingles)),
    laned AS MATERIALIZED (SELECT *, list_transform(range(0, n // 8), lambda i: {_number("8 * i", 8)}) AS lanes FROM spans),
    stripes AS MATERIALIZED (SELECT *, {_LANES_OF} FROM laned),
    begun AS MATERIALIZED (SELECT *, CASE WHEN n < 32 THEN {(SEED + int(_P5)) % (1 << 64)}::UHUGEINT ELSE {_MERGE} END AS h0 FROM stripes),
    eights AS MATERIALIZED (
        SELECT g, n, x, list_reduce(list_concat([{_add("h0", "n::UHUGEINT")}], list_transform(lanes[4 * (n // 32) + 1 :], lambda lane: {_round("0::UHUGEINT", "lane")})),
                                    lambda a, k: {_add(_mul(_rot("xor(a, k)", 27), 1), _MULTIPLY[4])}) AS h1
        FROM begun),
    fours AS MATERIALIZED (
        SELECT g, n, x, CASE WHEN n % 8 >= 4 THEN {_add(_mul(_rot(f"xor(h1, {_mul(_number('n - n % 8', 4), 1)})", 23), 2), _MULTIPLY[3])} ELSE h1 END AS h2 FROM eights),
    ones AS MATERIALIZED (
        SELECT g, list_reduce(list_concat([h2], list_transform(range(n - n % 4, n), lambda i: {_mul(_number("i", 1), 5)})), lambda a, b: {_mul(_rot("xor(a, b)", 11), 1)}) AS h3 FROM fours),
    mixed AS MATERIALIZED (SELECT g, {_mul(_shift("h3", 33), 2)} AS h4 FROM ones),
    stirred AS MATERIALIZED (SELECT g, {_mul(_shift("h4", 29), 3)} AS h5 FROM mixed),
    hashes AS MATERIALIZED (SELECT g, ({_shift("h5", 32)})::UBIGINT AS h FROM stirred),
    votes AS (SELECT r, bit, 2 * count(*) FILTER ((h >> bit) % 2 = 1) > count(*) AS set_ FROM shingles JOIN hashes USING (g), range(64) AS b(bit) GROUP BY r, bit),
    prints AS MATERIALIZED (
        SELECT doc_id, coalesce(v.fp, 0)::UBIGINT AS fp
        FROM docs LEFT JOIN (SELECT r, sum(CASE WHEN set_ THEN 1::UBIGINT << bit::UBIGINT ELSE 0::UBIGINT END) AS fp FROM votes GROUP BY r) v USING (r)),
    classes AS MATERIALIZED (SELECT fp, min(doc_id) AS first FROM prints GROUP BY fp),
    links AS MATERIALIZED (SELECT a.fp, b.fp AS other FROM classes a JOIN classes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {THRESHOLD}),
    reach AS (SELECT fp, fp AS other FROM classes UNION SELECT reach.fp, links.other FROM reach JOIN links ON reach.other = links.fp),
    components AS (SELECT reach.fp, min(first) AS component_id FROM reach JOIN classes ON reach.other = classes.fp GROUP BY reach.fp)
    SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN components USING (fp)"""
