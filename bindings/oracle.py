"""The registered queries as DuckDB SQL over the driver tables."""

from __future__ import annotations

import re

AS_OF = "DATE '1998-06-15'"
TARGET = "'NATION_2'"
NONE = "'NO COLLEGE'"
OTHERS = "'NATION_9','NATION_14','NATION_20','NATION_23'"
CHOSEN = f"{TARGET},{NONE},{OTHERS}"
SUMMERS = "199530,199630,199730"


def _age(birth: str, on: str) -> str:
    return (
        f"CAST(year({on}) - year({birth}) - CASE WHEN month({on}) * 100 + day({on}) "
        f"< month({birth}) * 100 + day({birth}) THEN 1 ELSE 0 END AS INTEGER)"
    )


def _season(term: str) -> str:
    return f"CASE {term} % 100 WHEN 20 THEN 'Spring' WHEN 30 THEN 'Summer' WHEN 40 THEN 'Fall' END"


def _year(term: str) -> str:
    return f"CAST({term} // 100 AS INTEGER)"


def _term(ymd: str) -> str:
    return (
        f"CAST(CASE WHEN {ymd} % 10000 BETWEEN 101 AND 430 THEN {ymd} // 10000 * 100 + 20 "
        f"WHEN {ymd} % 10000 BETWEEN 501 AND 731 THEN {ymd} // 10000 * 100 + 30 "
        f"WHEN {ymd} % 10000 BETWEEN 801 AND 1231 THEN {ymd} // 10000 * 100 + 40 END AS INTEGER)"
    )


def _ymd(day: str) -> str:
    return f"CAST(year({day}) * 10000 + month({day}) * 100 + day({day}) AS INTEGER)"


def _guard(aggregate: str, column: str) -> str:
    return f"CASE WHEN count(*) = count({column}) THEN {aggregate} END"


_BIRTH = (
    "make_date(CAST(1978 + o_custkey % 5 AS INTEGER), CAST(1 + o_custkey % 12 AS INTEGER), "
    "CAST(1 + o_custkey * 7 % 28 AS INTEGER))"
)
_TERM_END = (
    "CASE max_ce_term % 100 "
    "WHEN 20 THEN make_date(max_ce_term // 100, 5, 31) "
    "WHEN 30 THEN make_date(max_ce_term // 100, 8, 31) "
    "WHEN 40 THEN make_date(max_ce_term // 100, 12, 31) END"
)

_CE = f"""
        SELECT o_custkey AS sid, o_orderkey AS enroll_id, {_term(_ymd('o_orderdate'))} AS term,
               nullif(CAST(year(o_orderdate) AS INTEGER), 1996) AS hs_grad_year,
               translate(o_orderstatus, 'FOP', 'NUY') AS enrolled_after,
               CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Y'
                    WHEN o_orderpriority <> '5-LOW' THEN 'N' END AS ever_nonconcurrent,
               CASE WHEN o_totalprice > 250000 THEN 'Y' ELSE 'N' END AS within_one_year,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B+'
                    WHEN '3-MEDIUM' THEN 'C' WHEN '4-NOT SPECIFIED' THEN 'P' WHEN '5-LOW' THEN 'E'
               END AS final_grade,
               CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3.3
                    WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 0 END AS DOUBLE) AS grade_num,
               CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3.3
                    WHEN '3-MEDIUM' THEN 2 ELSE 0 END AS DOUBLE) AS grade_or_zero,
               CASE o_orderstatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' ELSE 'Unknown' END
                    AS gender,
               {_BIRTH} AS birth_date,
               {_age(_BIRTH, 'o_orderdate')} AS age_first_day,
               'B' || o_custkey AS inst_id
        FROM orders"""
_STUDENT = """
        SELECT {ce}.*, c_mktsegment AS ethnicity, c_name AS last_name,
               nullif(n_name, 'NATION_7') AS high_school, n_name AS campus,
               CAST(CASE WHEN n_name <> 'NATION_11' THEN 84000 + c_nationkey END AS DOUBLE) AS zip5,
               r_name AS region, n_name AS city,
               CASE WHEN c_acctbal > 5000 THEN 'Y' ELSE 'N' END AS pell_eligible,
               CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 2000 THEN 'Y' ELSE 'N' END
                    AS first_generation,
               CASE WHEN n_name NOT IN ('NATION_3','NATION_7') THEN r_name END AS district
        FROM {ce} JOIN customer ON sid = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""
_ROLLUP = f"""
        SELECT sid, count(*) AS num_ce, max(term) AS max_ce_term,
               {_guard('avg(grade_num)', 'grade_num')} AS ce_gpa,
               {_guard('max(enrolled_after)', 'enrolled_after')} AS enrolled_after,
               {_guard('max(gender)', 'gender')} AS gender,
               {_guard('max(ethnicity)', 'ethnicity')} AS ethnicity,
               {_guard('max(birth_date)', 'birth_date')} AS birth_date"""
_AGES = f"""
        SELECT *, {_age('birth_date', f'({_TERM_END})')} AS age_last_term,
               {_age('birth_date', AS_OF)} AS age_current,
               CASE WHEN enrolled_after = 'Y' THEN 'Y' WHEN enrolled_after <> 'Y' THEN 'N' END
                    AS outcome"""

# Common tables; a query lists the text that uses them and gets what it needs, in this order. The
# early ones hold the enrolments that later spells are looked for.
COMMON = {
    "ce": _CE,
    "early": _CE + " WHERE o_orderdate < TIMESTAMP '1998-01-01'",
    "ce_full": _STUDENT.format(ce="ce"),
    "early_full": _STUDENT.format(ce="early"),
    "courses": """
        SELECT sid, enroll_id, term, enrolled_after, birth_date, final_grade, grade_num, grade_or_zero,
               l_linenumber AS section, p_type AS subject, p_brand AS course_no,
               p_type || ' ' || p_brand AS class
        FROM lineitem JOIN ce ON l_orderkey = enroll_id JOIN part ON l_partkey = p_partkey""",
    "spell_rows": f"""
        SELECT o_custkey AS sid, CASE WHEN n_name = 'NATION_5' THEN '' ELSE n_name END AS college,
               CASE WHEN n_name <> 'NATION_5' THEN {_ymd('l_shipdate')} END AS begin_ymd,
               CASE WHEN n_name = 'NATION_5' THEN 'N' ELSE 'Y' END AS record_found,
               CASE WHEN l_linestatus = 'O' THEN 'Y' ELSE 'N' END AS graduated,
               CASE WHEN l_linestatus = 'O' THEN 'AWARD ' || l_linenumber END AS degree_title
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R'""",
    "all_spells": f"""
        SELECT *, CASE WHEN begin_ymd // 10000 BETWEEN 1995 AND 2000
                       THEN {_term('begin_ymd')} END AS term
        FROM spell_rows""",
    "spells": "SELECT * FROM all_spells WHERE graduated = 'N'",
    "rollup": _ROLLUP + " FROM ce_full GROUP BY sid",
    "students": _AGES + " FROM rollup",
    "early_rollup": _ROLLUP + " FROM early_full GROUP BY sid",
    "early_students": _AGES + " FROM early_rollup",
    "adults": "SELECT * FROM students WHERE age_current >= 18",
    "linked": "SELECT * FROM all_spells LEFT JOIN early_students USING (sid)",
    "later": "SELECT * FROM linked WHERE term > max_ce_term",
    "first": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY term, college) AS rn
                       FROM later) WHERE rn = 1""",
    "people": f"""
        SELECT * REPLACE (CASE WHEN college = '' THEN {NONE} ELSE college END AS college)
        FROM linked WHERE age_current >= 18 AND graduated = 'N'""",
    "bindall": f"""
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY sid ORDER BY term, college) AS rn
            FROM people WHERE term > max_ce_term) WHERE rn = 1
        UNION ALL SELECT * FROM people WHERE college = {NONE}""",
    "zips": """
        SELECT sid, zip5 FROM (SELECT sid, zip5, row_number() OVER (
            PARTITION BY sid ORDER BY enroll_id) AS rn FROM ce_full) WHERE rn = 1""",
    "cohort_base": f"""
        SELECT sid, term, max_ce_term, college, term - max_ce_term AS enroll_gap FROM (
            SELECT *, row_number() OVER (PARTITION BY sid ORDER BY term NULLS LAST, college) AS rn
            FROM bindall WHERE term > max_ce_term OR college = {NONE}) WHERE rn = 1""",
    "cohorts": """
        SELECT *, CAST(coalesce(CAST(enroll_gap <= 100 AS INTEGER), 0) AS INTEGER) AS enroll_1_yr,
               CAST(coalesce(CAST(enroll_gap <= 500 AS INTEGER), 0) AS INTEGER) AS enroll_5_yr
        FROM cohort_base""",
    "cohorts_inclusive": """
        SELECT *, CAST(coalesce(CAST(enroll_gap <= 120 AS INTEGER), 0) AS INTEGER) AS enroll_1_yr,
               CAST(coalesce(CAST(enroll_gap <= 520 AS INTEGER), 0) AS INTEGER) AS enroll_5_yr
        FROM cohort_base""",
    "cohort_campus": """
        SELECT cohorts.*, campus, r_name AS district FROM cohorts
        LEFT JOIN (SELECT sid, campus FROM (SELECT sid, campus, row_number() OVER (
            PARTITION BY sid ORDER BY enroll_id) AS rn FROM ce_full) WHERE rn = 1) USING (sid)
        LEFT JOIN nation ON campus = n_name LEFT JOIN region ON n_regionkey = r_regionkey""",
    "profile": f"""
        SELECT college, count(*) AS n,
        {", ".join(
            f"CASE WHEN count(*) = count({c}) THEN round_even("
            f"count(*) FILTER (WHERE {c} {t}) / count(*) * 100, 2) END AS {name}"
            for name, c, t in (
                *[(f"pc_age_{a}", "age_current", f"= {a}") for a in (16, 17, 18, 19)],
                ("pc_age_gt_19", "age_current", "> 19"),
                *[(f"pc_term_{t}", "max_ce_term", f"= {t}") for t in (199620, 199640, 199720, 199740)],
                ("pc_female", "gender", "= 'Female'"), ("pc_male", "gender", "= 'Male'"),
                ("pc_building", "ethnicity", "= 'BUILDING'"),
                ("pc_machinery", "ethnicity", "= 'MACHINERY'"),
            ))},
        round_even({_guard('avg(age_current)', 'age_current')}, 2) AS mean_age,
        round_even(avg(num_ce), 2) AS num_ce, round_even(avg(ce_gpa), 2) AS ce_gpa
        FROM bindall GROUP BY college""",
}


def _needs(text: str) -> set[str]:
    return {name for name in COMMON if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text)}


def with_common(body: str, recursive: str = "") -> str:
    needed, todo = set(), _needs(body + recursive)
    while todo:
        needed |= todo
        todo = set().union(*(_needs(COMMON[n]) for n in todo)) - needed
    tables = [f"{n} AS MATERIALIZED ({COMMON[n].strip()})" for n in COMMON if n in needed]
    if recursive:
        tables.append(recursive.strip())
    if not tables:
        return body.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(tables) + "\n" + body.strip()


def _top(table: str, k: int, order: str, within: str = "") -> str:
    part = f"PARTITION BY {within} " if within else ""
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER ({part}ORDER BY {order}) AS rn "
        f"FROM ({table})) WHERE rn <= {k}"
    )


def _share(table: str, name: str, within: str = "", scale: int = 1, digits: int | None = None) -> str:
    part = f"PARTITION BY {within}" if within else ""
    value = f"n / sum(n) OVER ({part})" + (f" * {scale}" if scale != 1 else "")
    if digits is not None:
        value = f"round_even({value}, {digits})"
    return f"SELECT *, {value} AS {name} FROM ({table})"


def _count(source: str, *keys: str, more: str = "") -> str:
    names = ", ".join(keys)
    return f"SELECT {names}, count(*) AS n{', ' + more if more else ''} FROM {source} GROUP BY {names}"


def _calendar(table: str) -> str:
    return f"SELECT *, {_year('term')} AS course_year, {_season('term')} AS course_sem FROM ({table})"


_BY_LOAD = _share(_count("adults", "num_ce", "outcome"), "freq", "num_ce")


def _capped(at: int) -> str:
    return _share(
        f"""SELECT least(num_ce, {at}) AS load_capped, outcome, count(*) AS n,
            min(num_ce) AS min_load FROM adults GROUP BY ALL""",
        "freq", "load_capped",
    )


def _newton(age: str) -> str:
    """Newton's method on the counts by (x, y), started where every probability is one half."""
    return f"""
        pts AS (SELECT CAST(num_ce AS DOUBLE) AS x, CASE outcome WHEN 'Y' THEN 1.0::DOUBLE ELSE 0 END AS y,
                       CAST(count(*) AS DOUBLE) AS w
                FROM students WHERE {age} >= 18 AND outcome IS NOT NULL GROUP BY 1, 2),
        newton AS (
            SELECT 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1
            UNION ALL
            SELECT k + 1, b0 + (i11 * g0 - i01 * g1) / (i00 * i11 - i01 * i01),
                   b1 + (i00 * g1 - i01 * g0) / (i00 * i11 - i01 * i01)
            FROM (SELECT k, b0, b1, sum(w * (y - p)) AS g0, sum(w * (y - p) * x) AS g1,
                         sum(w * p * (1 - p)) AS i00, sum(w * p * (1 - p) * x) AS i01,
                         sum(w * p * (1 - p) * x * x) AS i11
                  FROM (SELECT newton.*, pts.*, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM newton, pts
                        WHERE k < 25) GROUP BY k, b0, b1)),
        fit AS (SELECT b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) AS p, x, y, w
                FROM (SELECT * FROM newton WHERE k = 25), pts)"""


# Fisher scoring from probabilities 3/4 and 1/4: a row per step, with the deviance before it.
_SCORING = """
        scoring AS (
            SELECT 1 AS k, (i11 * g0 - i01 * g1) / (i00 * i11 - i01 * i01) AS b0,
                   (i00 * g1 - i01 * g0) / (i00 * i11 - i01 * i01) AS b1, dev
            FROM (SELECT sum(v) AS i00, sum(v * x) AS i01, sum(v * x * x) AS i11, sum(u) AS g0, sum(u * x) AS g1,
                         -2 * sum(w * ln(0.75::DOUBLE)) AS dev
                  FROM (SELECT x, w, w * 0.1875::DOUBLE AS v,
                               w * (0.1875::DOUBLE * ln(3::DOUBLE) + 0.25::DOUBLE) * (2 * y - 1) AS u FROM pts))
            UNION ALL
            SELECT k + 1, b0 + (i11 * g0 - i01 * g1) / (i00 * i11 - i01 * i01),
                   b1 + (i00 * g1 - i01 * g0) / (i00 * i11 - i01 * i01), dev
            FROM (SELECT k, b0, b1, sum(w * (y - p)) AS g0, sum(w * (y - p) * x) AS g1,
                         sum(w * p * (1 - p)) AS i00, sum(w * p * (1 - p) * x) AS i01,
                         sum(w * p * (1 - p) * x * x) AS i11,
                         -2 * sum(w * CASE y WHEN 1 THEN ln(p) ELSE ln(1 - p) END) AS dev
                  FROM (SELECT scoring.k, b0, b1, pts.*, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM scoring, pts
                        WHERE k < 26) GROUP BY k, b0, b1)),
        steps AS (SELECT min(k) AS iterations FROM (SELECT k, dev, lead(dev) OVER (ORDER BY k) AS after FROM scoring)
                  WHERE abs(after - dev) < 1e-8 * (abs(after) + 0.1))"""


def _logit(age: str) -> str:
    steps = _newton(age) + "," + _SCORING + """,
        total AS (
            SELECT b0, b1, sum(w * p * (1 - p)) AS i00, sum(w * p * (1 - p) * x) AS i01,
                   sum(w * p * (1 - p) * x * x) AS i11, sum(w) AS n, sum(w * y) / sum(w) AS ybar,
                   -2 * sum(w * (y * ln(p) + (1 - y) * ln(1 - p))) AS dev
            FROM fit GROUP BY b0, b1),
        estimates AS (SELECT '(Intercept)' AS term, b0 AS b, sqrt(i11 / (i00 * i11 - i01 * i01)) AS se, * FROM total
                 UNION ALL
                 SELECT 'num_ce', b1, sqrt(i00 / (i00 * i11 - i01 * i01)), * FROM total)"""
    return with_common(
        """SELECT term, round(b, 6) AS estimate, round(se, 6) AS std_error, round(b / se, 6) AS z,
           round(1 - 2 / sqrt(2 * pi()) * (
               SELECT sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                          * exp(-power(least(abs(b / se), 9) * i / 20000, 2) / 2))
                      * least(abs(b / se), 9) / 20000 / 3 FROM range(0, 20001) AS r(i)), 6) AS p_value,
           round(-2 * n * (ybar * ln(ybar) + (1 - ybar) * ln(1 - ybar)), 6) AS null_deviance,
           CAST(n AS BIGINT) - 1 AS null_df, round(dev, 6) AS residual_deviance,
           CAST(n AS BIGINT) - 2 AS residual_df, round(dev + 4, 6) AS aic,
           CAST(iterations AS INTEGER) AS iterations FROM estimates, steps""",
        steps,
    )


def _logit_residuals(age: str) -> str:
    quantile = ", ".join(
        f"round(quantile_cont(r, {p}), 6) AS {name}"
        for name, p in (('"min"', 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ('"max"', 1))
    )
    return with_common(
        f"""SELECT count(*) AS n, {quantile}
            FROM (SELECT CASE y WHEN 1 THEN sqrt(-2 * ln(p)) ELSE -sqrt(-2 * ln(1 - p)) END AS r
                  FROM fit JOIN students ON num_ce = x AND y = CASE outcome WHEN 'Y' THEN 1 ELSE 0 END
                  WHERE {age} >= 18)""",
        _newton(age),
    )


def _audit(rows: str, *checks: tuple[str, str, str, str]) -> str:
    """A row per check: field, expected, which rows are rejected, what is shown of them."""
    return with_common(" UNION ALL ".join(
        f"""SELECT '{field}' AS field, '{expected}' AS expected, count(*) AS n_lines,
            count(*) FILTER (WHERE {bad}) AS n_rejected, min(CASE WHEN {bad} THEN {shown} END) AS example FROM {rows}"""
        for field, expected, bad, shown in checks
    ))


_TOO_FEW = "as many fields as the header"


def _line(sep: str, *values: str) -> str:
    return f" || '{sep}' || ".join(f"coalesce(CAST({v} AS VARCHAR), 'NA')" for v in values)


_SHORT_LINE = _line(
    "\t", "sid", "term", "hs_grad_year", "enrolled_after", "ever_nonconcurrent", "last_name",
    "CASE WHEN sid % 17 = 2 THEN '31-FEB-1979' ELSE strftime(birth_date, '%d-%b-%Y') END", "inst_id", "gender",
    "ethnicity", "final_grade", "high_school",
)
_LONG_LINE = _line(
    ",", "sid", "record_found", "CASE college WHEN '' THEN '\"\"' ELSE college END",
    "CASE WHEN sid % 13 = 4 THEN 'May 1997' ELSE CAST(begin_ymd AS VARCHAR) END", "graduated", "degree_title",
    "'more'",
)


def _loess(at: int, direct: bool = False) -> str:
    """Blended local fits with their band; with ``direct`` the fits of the grid positions themselves.

    Cells are cut at the middle ranks, ``local`` holds what a local fit's value and slope give each point,
    ``hat`` what the blended fit at a target gives it, and ``gap`` the matrix (I-L)(I-L)'.
    """
    steps = f"""
        pts AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY min_load) AS i, CAST(min_load AS DOUBLE) AS px, freq AS py
            FROM ({_capped(at)}) WHERE outcome = 'Y'),
        size AS MATERIALIZED (
            SELECT count(*) AS n, min(px) AS lo, max(px) AS hi,
                   CAST(floor(count(*) * 0.75::DOUBLE + 1e-5) AS BIGINT) AS q,
                   CAST(floor(count(*) * 0.75::DOUBLE * 0.2::DOUBLE) AS BIGINT) AS most FROM pts),
        cells AS (
            SELECT 1::BIGINT AS l, n AS u FROM size
            UNION ALL
            SELECT CASE side WHEN 0 THEN l ELSE (l + u) // 2 + 1 END, CASE side WHEN 0 THEN (l + u) // 2 ELSE u END
            FROM cells, size, (VALUES (0), (1)) AS sides(side) WHERE u - l + 1 > most AND u > l),
        grid AS MATERIALIZED (SELECT CAST(g AS INTEGER) AS g, lo + g * ((hi - lo) / 79) AS x FROM size, range(0, 80) AS r(g)),
        vertices AS MATERIALIZED (
            SELECT v, lead(v) OVER (ORDER BY v) AS next FROM (
                SELECT lo - 0.1::DOUBLE * (hi - lo) AS v FROM size UNION SELECT hi + 0.1::DOUBLE * (hi - lo) FROM size
                UNION SELECT (a.px + b.px) / 2 FROM cells, size, pts a, pts b
                WHERE u - l + 1 > most AND u > l AND a.i = (l + u) // 2 AND b.i = (l + u) // 2 + 1)),
        centres AS MATERIALIZED (SELECT v FROM vertices{" UNION SELECT x FROM grid" if direct else ""}),
        weighted AS MATERIALIZED (
            SELECT v, i, py, d, power(1 - power(abs(d) / h, 3), 3) AS w FROM (
                SELECT v, i, py, px - v AS d, max(CASE WHEN rn = q THEN abs(px - v) END) OVER (PARTITION BY v) AS h
                FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY abs(px - v)) AS rn FROM centres, pts, size))
            WHERE abs(d) < h),
        sums AS MATERIALIZED (
            SELECT v, sum(w) s0, sum(w*d) s1, sum(w*d*d) s2, sum(w*d*d*d) s3, sum(w*d*d*d*d) s4 FROM weighted GROUP BY v),
        local AS MATERIALIZED (
            SELECT v, i, w * ((s2*s4-s3*s3) + (s2*s3-s1*s4)*d + (s1*s3-s2*s2)*d*d) / det AS level,
                   w * ((s2*s3-s1*s4) + (s0*s4-s2*s2)*d + (s1*s2-s0*s3)*d*d) / det AS slope
            FROM (SELECT *, s0*(s2*s4-s3*s3) + s1*(s2*s3-s1*s4) + s2*(s1*s3-s2*s2) AS det FROM weighted JOIN sums USING (v))),
        targets AS MATERIALIZED (SELECT -1 - g AS id, x FROM grid UNION ALL SELECT i, px FROM pts),
        blend AS MATERIALIZED (
            SELECT id, v, next, next - v AS width, (x - v) / (next - v) AS t FROM targets, vertices WHERE x >= v AND x < next),
        hat AS MATERIALIZED (
            SELECT id, i, sum(part) AS l FROM (
                SELECT id, i, (1 + 2*t) * (1-t) * (1-t) * level + width * t * (1-t) * (1-t) * slope AS part
                FROM blend JOIN local USING (v)
                UNION ALL
                SELECT id, i, t*t * (3 - 2*t) * level + width * t*t * (t-1) * slope
                FROM blend JOIN local ON next = local.v) GROUP BY id, i),
        gap AS MATERIALIZED (
            SELECT a.i AS a, b.i AS b, (a.i = b.i)::INTEGER - coalesce((SELECT l FROM hat WHERE id = a.i AND i = b.i), 0)
                   - coalesce((SELECT l FROM hat WHERE id = b.i AND i = a.i), 0)
                   + (SELECT sum(x.l * y.l) FROM hat x JOIN hat y USING (i) WHERE x.id = a.i AND y.id = b.i) AS m
            FROM pts a, pts b),
        spread AS MATERIALIZED (
            SELECT sqrt(rss / d1) AS s, d1 * d1 / d2 AS dof FROM
                (SELECT sum(CASE WHEN a = b THEN m END) AS d1, sum(m * m) AS d2 FROM gap),
                (SELECT sum(power(p.py - f, 2)) AS rss FROM pts p JOIN
                    (SELECT id, sum(l * py) AS f FROM hat JOIN pts USING (i) GROUP BY id) ON id = p.i)),
        fits AS MATERIALIZED (
            {"SELECT g, x, sum(level * py) AS fitted, sqrt(sum(level * level)) AS norm FROM grid JOIN local ON v = x JOIN pts USING (i) GROUP BY g, x"
             if direct else
             "SELECT g, x, sum(l * py) AS fitted, sqrt(sum(l * l)) AS norm FROM grid JOIN hat ON id = -1 - g JOIN pts USING (i) GROUP BY g, x"}),
        reach AS MATERIALIZED (SELECT s, {_reach()} AS reach FROM spread)"""
    return with_common(
        """SELECT g AS grid_id, round(x, 6) AS x, round(fitted, 6) AS fitted, round(s * norm, 6) AS std_error,
                  round(fitted - reach * s * norm, 6) AS lower, round(fitted + reach * s * norm, 6) AS upper
           FROM fits, reach""",
        steps,
    )


def _reach() -> str:
    """The t with 95 % between it and its negative: its angle is where the trapezoid sums of
    cos^(df-1) reach 95 %."""
    return """(SELECT sqrt(dof) * tan(pi() / 2 * (i - 1 + (goal - before) / (after - before)) / 40000)
        FROM (SELECT i, after, lag(after, 1, 0) OVER (ORDER BY i) AS before,
                     0.95 * max(after) OVER () AS goal
              FROM (SELECT i, sum((power(cos(pi() / 2 * i / 40000), dof - 1)
                           + power(cos(pi() / 2 * (i - 1) / 40000), dof - 1)) / 2) OVER (ORDER BY i) AS after
                    FROM range(1, 40001) AS r(i)))
        WHERE after >= goal ORDER BY i LIMIT 1)"""


def _ttest(value: str, equal_var: bool) -> str:
    """The p-value integrates cos^(df-1) over the angle whose tangent is t / sqrt(df)."""
    if equal_var:
        dof = "CAST(n_a + n_b - 2 AS DOUBLE)"
        se = "sqrt(((n_a-1)*var_a + (n_b-1)*var_b) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b))"
    else:
        dof = (
            "power(var_a/n_a + var_b/n_b, 2) / (power(var_a/n_a, 2) / (n_a-1) "
            "+ power(var_b/n_b, 2) / (n_b-1))"
        )
        se = "sqrt(var_a/n_a + var_b/n_b)"
    return with_common(f"""
        SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
               round(se, 6) AS std_error, round(dof, 6) AS df, round(t, 6) AS t,
               round(1 - inside * atan(abs(t) / sqrt(dof)) / (pi() / 2) / whole, 6) AS p_value,
               round(mean_a - mean_b - se * reach, 6) AS ci_low,
               round(mean_a - mean_b + se * reach, 6) AS ci_high
        FROM (
            SELECT n_a, n_b, mean_a, mean_b, se, dof, t, {_reach()} AS reach,
                   sum(weight * power(cos(pi() / 2 * i / 40000), dof - 1)) AS whole,
                   sum(weight * power(cos(atan(abs(t) / sqrt(dof)) * i / 40000), dof - 1)) AS inside
            FROM (SELECT *, {dof} AS dof, {se} AS se, (mean_a - mean_b) / ({se}) AS t FROM (
                SELECT count(a) AS n_a, count(b) AS n_b, avg(a) AS mean_a, avg(b) AS mean_b,
                       var_samp(a) AS var_a, var_samp(b) AS var_b
                FROM (SELECT CASE WHEN college = {NONE} THEN {value} END AS a,
                             CASE WHEN college = {TARGET} THEN {value} END AS b FROM bindall))),
                 (SELECT i, CASE WHEN i IN (0, 40000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight
                  FROM range(0, 40001) AS r(i))
            GROUP BY n_a, n_b, mean_a, mean_b, se, dof, t)""")


def _box(source: str, group: str, value: str, hinges: bool = False, where: str = "") -> str:
    """Quartiles by interpolation, or hinges from the order statistics at their depth."""
    rows = f"SELECT {group}, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL {where}"
    if hinges:
        depth = "(floor((n + 3) / 2) / 2)"

        def at(place):
            return (
                f"(max(CASE WHEN rn = floor({place}) THEN v END) "
                f"+ max(CASE WHEN rn = ceil({place}) THEN v END)) / 2"
            )

        boxes = f"""SELECT {group}, {at(depth)} AS q1, {at('((n + 1) / 2)')} AS median,
            {at(f'(n + 1 - {depth})')} AS q3 FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS n,
            row_number() OVER (PARTITION BY {group} ORDER BY v) AS rn FROM ({rows})) GROUP BY {group}"""
    else:
        boxes = f"""SELECT {group}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
            quantile_cont(v, 0.75) AS q3 FROM ({rows}) GROUP BY {group}"""
    inside = "v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return with_common(f"""
        SELECT {group}, count(*) AS n, round(max(q1), 6) AS q1, round(max(median), 6) AS median,
               round(max(q3), 6) AS q3, round(min(v) FILTER (WHERE {inside}), 6) AS whisker_low,
               round(max(v) FILTER (WHERE {inside}), 6) AS whisker_high,
               count(*) FILTER (WHERE NOT ({inside})) AS n_outliers
        FROM ({rows}) JOIN ({boxes}) USING ({group}) GROUP BY {group}""")


_FUNNEL = """
    SELECT hs_grad_year, count(*) AS n, {sums} FROM (
        SELECT *, row_number() OVER (PARTITION BY sid, hs_grad_year ORDER BY enroll_id) AS rn FROM ce
        WHERE hs_grad_year > 1994 AND hs_grad_year < 1998) WHERE rn = 1 GROUP BY hs_grad_year
""".format(sums=", ".join(
    f"CAST({_guard(f'sum(CAST({c} = ' + chr(39) + 'Y' + chr(39) + ' AS INTEGER))', c)} AS BIGINT) AS {name}"
    for name, c in (
        ("ever", "ever_nonconcurrent"), ("enrollafter", "enrolled_after"), ("within1", "within_one_year"),
    )))

_SUBSET = f"""(SELECT *, CASE WHEN enrolled_after = 'Y' THEN 'Y' ELSE 'N' END AS outcome FROM (
    SELECT *, row_number() OVER (PARTITION BY sid ORDER BY enroll_id, section, course_no) AS rn
    FROM courses WHERE subject = 'PROMO') WHERE rn = 1 AND {_age('birth_date', AS_OF)} >= 18)"""


def _outcome(age: str) -> str:
    return _count(f"(SELECT * FROM students WHERE {age} >= 18)", "outcome")


def _first_top(k: int, digits: int | None, source: str = "first") -> str:
    table = _share(_count(source, "college"), "percent", "", 100, digits)
    return with_common(_top(table, k, "n DESC, college" if digits is None else "percent DESC, college"))


def _ranked(metric: str, order: str, where: str = "", k: int | None = None) -> str:
    table = f"SELECT college, n, {metric} FROM profile {where}"
    if k:
        table = _top(table, k, "n DESC, college")
    return with_common(
        f"SELECT *, row_number() OVER (ORDER BY {order} DESC, college) AS sort_rank "
        f"FROM ({table})"
    )


def _zip_top(source: str) -> str:
    return with_common(_top(
        f"SELECT * FROM ({_count(f'(SELECT DISTINCT sid, zip5 FROM {source})', 'zip5')}) "
        "WHERE zip5 IS NOT NULL", 10, "n DESC, zip5",
    ))


def _yields(source: str, where: str) -> str:
    return f"""SELECT max_ce_term, count(*) AS n, CAST(sum(enroll_1_yr) AS BIGINT) AS enroll_1_yr,
        CAST(sum(enroll_5_yr) AS BIGINT) AS enroll_5_yr, sum(enroll_1_yr) / count(*) AS pc_1_year,
        sum(enroll_5_yr) / count(*) AS pc_5_yr FROM {source} WHERE {where} GROUP BY max_ce_term"""


_FULL = f"max_ce_term NOT IN ({SUMMERS}) AND max_ce_term < 199800"


def _yield_overall(source: str) -> str:
    return with_common(f"""SELECT count(*) AS n, CAST(sum(enroll_1_yr) AS BIGINT) AS sum_1_yr,
        CAST(sum(enroll_5_yr) AS BIGINT) AS sum_5_yr, sum(enroll_1_yr) / count(*) AS pc_enroll
        FROM {source} WHERE {_FULL}""")


def _yield_table(source: str) -> str:
    return with_common(
        f"SELECT *, {_season('max_ce_term')} AS semester FROM ({_yields(source, _FULL)})"
    )


def _by(where: str, by: str) -> str:
    table = _count(f"(SELECT * FROM cohort_campus WHERE {where})", by)
    return with_common(_share(table, "pc", "", 100, 1))


def _heads(school: str, where: str) -> str:
    return f"SELECT term, {school}, count(DISTINCT sid) AS n FROM ce_full WHERE {where} GROUP BY ALL"


def _school_share(school: str, where: str, k: int, missing: str, digits: int = 1) -> str:
    heads = _heads(school, where + ("" if missing == "" else f" AND {school} IS NOT NULL"))
    top = _top(_share(heads, "pc", "term", 100, digits), k, f"n DESC, {school}", "term")
    return with_common(
        f"""SELECT t.*, d.district FROM ({top}) t LEFT JOIN (SELECT n_name, r_name AS district
        FROM nation JOIN region ON n_regionkey = r_regionkey
        {"WHERE n_name NOT IN ('NATION_3','NATION_7')" if school == 'high_school' else ''}) d
        ON t.{school} = d.n_name"""
    )


def _gender(by: str) -> str:
    return with_common(f"""
        SELECT *, female / n AS pcfemale FROM (
            SELECT {by}, count(*) AS n, CAST(sum(CAST(gender = 'Male' AS INTEGER)) AS BIGINT) AS male,
                   CAST(sum(CAST(gender = 'Female' AS INTEGER)) AS BIGINT) AS female
            FROM (SELECT {by}, sid, max(gender) AS gender FROM (
                SELECT *, {_year('term')} AS course_year FROM ce WHERE term > 199540) GROUP BY ALL)
            GROUP BY {by})""")


def _load_by(attribute: str, unknown: str) -> str:
    return with_common(f"""
        SELECT {attribute}, count(*) AS students, round(avg(n), 6) AS avg_courses,
               round(stddev_samp(n), 6) AS sd
        FROM (SELECT sid, count(*) AS n, max({attribute}) AS {attribute} FROM ce_full GROUP BY sid)
        WHERE {attribute} <> '{unknown}' GROUP BY {attribute}""")


def _zip_region(where: str, lead: str = "", shares: bool = False) -> str:
    keys = f"{lead}, " if lead else ""
    table = f"""SELECT {keys}zip, count(*) AS n, arg_min(region, sid) AS region, arg_min(city, sid) AS city
        FROM (SELECT {keys}sid, {_guard('max(zip5)', 'zip5')} AS zip, arg_min(region, enroll_id) AS region,
                     arg_min(city, enroll_id) AS city FROM ce_full WHERE {where} GROUP BY {keys}sid)
        GROUP BY {keys}zip"""
    if shares:
        table = _share(table, "pczip", lead)
    return with_common(_top(f"SELECT * FROM ({table}) WHERE zip IS NOT NULL", 15, "n DESC, zip", lead))


_MISSING_IDS = f"""SELECT sid, {_guard('max(id)', 'id')} AS inst_id FROM (
    SELECT sid, CASE WHEN enroll_id % 7 <> 0 THEN inst_id END AS id FROM ce) GROUP BY sid"""

ORACLE = {
    "null_audit": with_common("""
        SELECT count(*) FILTER (WHERE hs_grad_year IS NULL) AS null_all,
               count(*) FILTER (WHERE hs_grad_year IS NULL AND ever_nonconcurrent = 'Y'
                                AND enrolled_after = 'N') AS null_odd,
               count(*) FILTER (WHERE ever_nonconcurrent = 'Y' AND enrolled_after = 'N') AS n_odd
        FROM ce"""),
    "grad_year_funnel": with_common(_FUNNEL),
    "roster_distinct": with_common("SELECT DISTINCT sid, last_name, birth_date FROM ce_full"),
    "term_bounds": with_common("SELECT min(term) AS min_term, max(term) AS max_term FROM ce"),
    "student_rollup": with_common("SELECT * REPLACE (round(ce_gpa, 6) AS ce_gpa) FROM rollup"),
    "age_at_event": with_common(
        "SELECT sid, max_ce_term, birth_date, age_last_term, age_current FROM students"
    ),
    "age_frequency": with_common(
        _count("(SELECT * FROM students WHERE age_current IS NOT NULL)", "age_current")
    ),
    "adult_students": with_common("SELECT sid, age_last_term FROM students WHERE age_last_term >= 18"),
    "outcome_counts": with_common(_outcome("age_last_term")),
    "outcome_counts_current": with_common(_outcome("age_current")),
    "outcome_share": with_common(_share(_outcome("age_last_term"), "freq")),
    "outcome_share_current": with_common(
        "SELECT *, CAST(CAST(round_even(freq * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS freq_label "
        f"FROM ({_share(_outcome('age_current'), 'freq')})"
    ),
    "term_volume": with_common(_calendar(_count("ce WHERE term > 199520", "term"))),
    "term_headcount": with_common(_calendar(
        "SELECT term, count(DISTINCT sid) AS n FROM ce WHERE term > 199520 GROUP BY term"
    )),
    "mean_course_load": with_common(
        "SELECT *, round_even(mean_courses, 1) AS mean_courses_1dp FROM ("
        + _calendar(
            f"SELECT term, avg(n) AS mean_courses FROM ({_count('ce WHERE term > 199520', 'term', 'sid')}) "
            "GROUP BY term"
        )
        + ")"
    ),
    "course_count_dist": with_common(
        "SELECT num_courses, count(*) AS n FROM (SELECT sid, count(*) AS num_courses FROM ce "
        "GROUP BY sid) GROUP BY num_courses"
    ),
    "overall_mean_load": with_common(
        f"SELECT avg(n) AS avg_courses FROM ({_count('ce WHERE term > 199620', 'sid')})"
    ),
    "logit_outcome": _logit("age_last_term"),
    "logit_outcome_current": _logit("age_current"),
    "logit_residuals": _logit_residuals("age_last_term"),
    "outcome_by_load": with_common(_BY_LOAD),
    "outcome_by_load_capped": with_common(_capped(8)),
    "outcome_by_load_capped_yes": with_common(f"SELECT * FROM ({_capped(8)}) WHERE outcome = 'Y'"),
    "outcome_loess": _loess(16),
    "outcome_loess_direct": _loess(16, direct=True),
    "common_courses": with_common(_top(
        _count("courses", "class", more="round(avg(grade_num), 6) AS average_grade"), 10, "n DESC, class"
    )),
    "retakes": with_common(
        "SELECT * FROM ("
        + _count(
            "courses", "sid", "class",
            more="round(avg(grade_num), 6) AS mean_grade, min(grade_num) AS min_grade, "
            "max(grade_num) AS max_grade, min(term) AS first_term, max(term) AS last_term",
        )
        + ") WHERE n > 1"
    ),
    "common_subjects": with_common(_top(_count("courses", "subject"), 4, "n DESC, subject")),
    "subset_outcome": with_common(_count(_SUBSET, "outcome")),
    "subset_outcome_by_course": with_common(_count(_SUBSET, "course_no", "outcome")),
    "age_share_slice": with_common(
        "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY age_first_day) AS rn FROM ("
        + _share(_count("ce", "age_first_day"), "pc", "", 100, 1)
        + ")) WHERE rn BETWEEN 3 AND 5"
    ),
    "person_lookup": with_common(
        "SELECT sid, enroll_id, term, enrolled_after, age_first_day FROM ce WHERE sid = 17"
    ),
    "enrollment_lines": with_common("""
        SELECT sid, term, hs_grad_year, enrolled_after, ever_nonconcurrent, last_name, birth_date,
               inst_id, gender, ethnicity, final_grade, high_school, age_first_day FROM ce_full"""),
    "enrollment_file": with_common("""
        SELECT sid, term, hs_grad_year, enrolled_after, ever_nonconcurrent, last_name,
               CASE WHEN sid % 17 <> 2 THEN birth_date END AS birth_date, inst_id, gender, ethnicity, final_grade,
               high_school, CASE WHEN sid % 13 <> 1 THEN age_first_day END AS age_first_day
        FROM ce_full WHERE sid % 11 <> 0"""),
    "enrollment_file_audit": _audit(
        "ce_full",
        ("(line)", _TOO_FEW, "sid % 11 = 0", _SHORT_LINE),
        ("sid", "long", "false", "NULL::VARCHAR"),
        ("term", "int", "false", "NULL::VARCHAR"),
        ("hs_grad_year", "int", "false", "NULL::VARCHAR"),
        ("birth_date", "date", "sid % 11 <> 0 AND sid % 17 = 2", "'31-FEB-1979'"),
        ("age_first_day", "int", "sid % 11 <> 0 AND sid % 13 = 1", "'about 17'"),
    ),
    "spell_file": with_common("""
        SELECT sid, record_found, college, CASE WHEN sid % 13 <> 4 THEN begin_ymd END AS begin_ymd, graduated,
               degree_title FROM all_spells WHERE sid % 11 <> 3"""),
    "spell_file_audit": _audit(
        "all_spells",
        ("(line)", _TOO_FEW, "sid % 11 = 3", _LONG_LINE),
        ("sid", "long", "false", "NULL::VARCHAR"),
        ("begin_ymd", "int", "sid % 11 <> 3 AND sid % 13 = 4", "'May 1997'"),
    ),
    "spell_lines": with_common(
        "SELECT sid, record_found, college, begin_ymd, graduated, degree_title FROM all_spells"
    ),
    "prepare_enrollments": with_common(f"""
        SELECT sid, enroll_id, CAST(enrolled_after = 'Y' AS INTEGER) AS enrolled_after_01,
               CAST(ever_nonconcurrent = 'Y' AS INTEGER) AS ever_nonconcurrent_01,
               CAST(within_one_year = 'Y' AS INTEGER) AS within_one_year_01,
               {_year('term')} AS course_year, {_season('term')} AS course_sem, grade_num, zip5,
               'enrollments' AS source, 'Y' AS ce_term FROM ce_full"""),
    "prepare_spells": with_common(
        "SELECT sid, college, begin_ymd, term, 'spells' AS source FROM all_spells"
    ),
    "spell_term": with_common(_count("all_spells", "begin_ymd", "term")),
    "target_begin_dates": with_common(
        f"""SELECT *, CAST(CASE WHEN begin_ymd > 19970501 AND begin_ymd < 19970731 THEN 199730
            WHEN begin_ymd IS NOT NULL THEN 0 END AS INTEGER) AS term_code
        FROM ({_count(f'all_spells WHERE college = {TARGET}', 'begin_ymd')})"""
    ),
    "unmatched_left": with_common("""
        SELECT sid, term, enroll_id FROM ce WHERE NOT EXISTS (
            SELECT 1 FROM all_spells s WHERE s.sid = ce.sid AND s.term IS NOT DISTINCT FROM ce.term)"""),
    "unmatched_right": with_common("""
        SELECT sid, term, college FROM all_spells s WHERE NOT EXISTS (
            SELECT 1 FROM ce c WHERE c.sid = s.sid AND c.term IS NOT DISTINCT FROM s.term)"""),
    "stack_sources": with_common("""
        SELECT sid, term, final_grade, NULL AS college, 'enrollments' AS source FROM ce
        UNION ALL SELECT sid, term, NULL, college, 'spells' FROM all_spells"""),
    "linked_term": with_common("""
        SELECT ce.sid, ce.term, ce.enroll_id, s.college FROM ce LEFT JOIN all_spells s
        ON ce.sid = s.sid AND ce.term IS NOT DISTINCT FROM s.term"""),
    "linked_term_split": with_common("""
        SELECT ce.sid, ce.term, ce.enroll_id, s.college FROM ce LEFT JOIN all_spells s
        ON ce.sid = s.sid AND ce.term IS NOT DISTINCT FROM s.term"""),
    "linked_term_size": with_common("""
        SELECT count(*) AS n, count(*) FILTER (WHERE s.sid IS NULL) AS n_unmatched,
               count(DISTINCT ce.sid || ' ' || coalesce(CAST(ce.term AS VARCHAR), '')) AS n_keys
        FROM ce LEFT JOIN all_spells s ON ce.sid = s.sid AND ce.term IS NOT DISTINCT FROM s.term"""),
    "linked_term_by_college": with_common("""
        SELECT ce.term, ce.enrolled_after, s.college, count(*) AS n FROM ce LEFT JOIN all_spells s
        ON ce.sid = s.sid AND ce.term IS NOT DISTINCT FROM s.term GROUP BY ALL"""),
    "linked_by_bucket": with_common("""
        SELECT s.sid, s.term, s.college, r.num_ce, r.max_ce_term FROM all_spells s LEFT JOIN
        (SELECT sid, count(*) AS num_ce, max(term) AS max_ce_term FROM ce GROUP BY sid) r USING (sid)
        WHERE s.term >= 199620"""),
    "linked_spells": with_common("""
        SELECT sid, term, college, num_ce, round(ce_gpa, 6) AS ce_gpa, max_ce_term, enrolled_after, gender
        FROM linked"""),
    "spells_after": with_common("SELECT sid, term, college, max_ce_term FROM later"),
    "first_college": with_common("SELECT sid, term, college, max_ce_term FROM first"),
    "award_titles": with_common(_count("all_spells", "degree_title")),
    "latest_spell": with_common("""
        SELECT a.sid, age_current, term, college FROM adults a LEFT JOIN (
            SELECT * FROM (SELECT sid, term, college, row_number() OVER (
                PARTITION BY sid ORDER BY term DESC NULLS LAST, college) AS rn FROM all_spells)
            WHERE rn = 1) l ON a.sid = l.sid"""),
    "completions": with_common(
        "SELECT sid, term, college, degree_title FROM all_spells WHERE graduated = 'Y'"
    ),
    "non_completions": with_common("SELECT sid, term, college FROM spells"),
    "prior_target": with_common(f"""
        SELECT sid, min(term) AS term, any_value(max_ce_term) AS max_ce_term FROM linked
        WHERE graduated = 'N' AND college = {TARGET} AND term <= max_ce_term GROUP BY sid"""),
    "linked_without_prior": with_common(f"""
        SELECT sid, term, college, max_ce_term FROM linked WHERE NOT EXISTS (
            SELECT 1 FROM (SELECT sid, min(term) AS term FROM linked
                           WHERE graduated = 'N' AND college = {TARGET} AND term <= max_ce_term
                           GROUP BY sid) p
            WHERE p.sid = linked.sid AND p.term IS NOT DISTINCT FROM linked.term)"""),
    "max_term_attach": with_common(
        "SELECT sid, term, college, max(term) OVER (PARTITION BY sid) AS max_term FROM all_spells"
    ),
    "no_record_export": with_common("""
        SELECT s.sid, record_found, graduated, inst_id FROM all_spells s LEFT JOIN (
            SELECT sid, max(inst_id) AS inst_id FROM ce GROUP BY sid) i ON s.sid = i.sid
        WHERE record_found = 'N'"""),
    "id_by_student": with_common("SELECT sid, max(inst_id) AS inst_id FROM ce GROUP BY sid"),
    "id_by_student_missing": with_common(f"SELECT * FROM ({_MISSING_IDS})"),
    "no_record_export_missing": with_common(f"""
        SELECT s.sid, record_found, graduated, inst_id FROM all_spells s LEFT JOIN ({_MISSING_IDS}) i
        ON s.sid = i.sid WHERE record_found = 'N'"""),
    "spell_kind": with_common(f"""
        SELECT sid, begin_ymd, CASE WHEN college = '' THEN 'concurrent' ELSE 'college' END AS con_college,
               CASE WHEN college = '' THEN {NONE} ELSE college END AS college_label FROM all_spells"""),
    "first_college_or_none": with_common("""
        SELECT sid, term, college, max_ce_term, num_ce, round(ce_gpa, 6) AS ce_gpa, gender, age_current
        FROM bindall"""),
    "student_zip": with_common("SELECT sid, zip5 FROM zips"),
    "linked_with_zip": with_common(
        "SELECT f.sid, term, college, max_ce_term, zip5 FROM first f LEFT JOIN zips z ON f.sid = z.sid"
    ),
    "first_college_top": _first_top(10, None),
    "first_college_top_rounded": _first_top(11, 1, "bindall"),
    "first_college_top_without_target": _first_top(10, 1, f"bindall WHERE college <> {TARGET}"),
    "college_ever_top": with_common(_top(
        """SELECT college, count(DISTINCT sid) AS n, count(DISTINCT sid)
           / (SELECT count(DISTINCT sid) FROM later) * 100 AS percent FROM later GROUP BY college""",
        10, "n DESC, college",
    )),
    "first_or_none_top": with_common(_top(_count("bindall", "college"), 10, "n DESC, college")),
    "college_profile": with_common("SELECT * FROM profile"),
    "profile_metric_rank": _ranked("pc_building", "pc_building", f"WHERE college IN ({CHOSEN})"),
    "profile_metric_rank_by_size": _ranked("ce_gpa", "n", k=10),
    "gpa_box": _box("bindall", "college", "ce_gpa", where=f"AND college IN ({TARGET},{NONE})"),
    "gpa_box_hinges": _box("bindall", "college", "ce_gpa", True, f"AND college IN ({TARGET},{NONE})"),
    "load_box": _box("bindall", "college", "num_ce", where=f"AND college IN ({TARGET},{NONE})"),
    "load_box_outliers": with_common(f"""
        SELECT sid, college, num_ce FROM bindall JOIN (
            SELECT college, quantile_cont(num_ce, 0.25) AS q1, quantile_cont(num_ce, 0.75) AS q3
            FROM bindall WHERE college IN ({TARGET},{NONE}) GROUP BY college) USING (college)
        WHERE num_ce < q1 - 1.5 * (q3 - q1) OR num_ce > q3 + 1.5 * (q3 - q1)"""),
    "price_box": _box("orders", "o_orderpriority", "o_totalprice"),
    "gpa_welch": _ttest("ce_gpa", False),
    "load_ttest": _ttest("num_ce", True),
    "load_welch": _ttest("num_ce", False),
    "zip_top": _zip_top("zips"),
    "zip_top_target": _zip_top(f"bindall LEFT JOIN zips USING (sid) WHERE college = {TARGET}"),
    "zip_top_none": _zip_top(f"bindall LEFT JOIN zips USING (sid) WHERE college = {NONE}"),
    "zip_top_by_college": with_common(_top(
        "SELECT * FROM ("
        + _count(
            f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid
                ORDER BY term NULLS LAST, college) AS rn FROM bindall) LEFT JOIN zips USING (sid)
                WHERE rn = 1 AND college IN ({CHOSEN}))""",
            "college", "zip5",
        )
        + ") WHERE zip5 IS NOT NULL",
        5, "n DESC, zip5", "college",
    )),
    "course_mix": with_common(_top(
        _share(
            f"""SELECT f.college, class, count(*) AS n,
                round({_guard('avg(grade_or_zero)', 'grade_or_zero')}, 6) AS avg_grade
            FROM bindall f LEFT JOIN courses c ON f.sid = c.sid
            WHERE f.college IN ({TARGET},{NONE},'NATION_9') GROUP BY ALL""",
            "pc_course", "college", 100, 1,
        ),
        10, "pc_course DESC, class", "college",
    )),
    "attend_share": with_common(_share(
        f"SELECT CASE WHEN college = {TARGET} THEN 'Y' ELSE 'N' END AS attend, count(*) AS n "
        "FROM bindall GROUP BY ALL", "pc_attend", "", 100, 1,
    )),
    "boundary_check": with_common(
        "SELECT max_ce_term = term AS same_term, count(*) AS n FROM bindall GROUP BY ALL"
    ),
    "cohort_gap": with_common("SELECT * FROM cohorts"),
    "cohort_gap_inclusive": with_common("SELECT * FROM cohorts_inclusive"),
    "cohort_yield_overall": _yield_overall("cohorts"),
    "cohort_yield_overall_inclusive": _yield_overall("cohorts_inclusive"),
    "cohort_yield": _yield_table("cohorts"),
    "cohort_yield_inclusive": _yield_table("cohorts_inclusive"),
    "cohort_yield_mean": with_common(
        "SELECT round(avg(pc_1_year), 6) AS avg FROM ("
        + _yields("cohorts", "max_ce_term IN (199520, 199620, 199720)") + ")"
    ),
    "cohort_yield_mean_fall": with_common(
        "SELECT round(avg(pc_1_year), 6) AS avg FROM ("
        + _yields("cohorts", "max_ce_term IN (199540, 199640, 199740)") + ")"
    ),
    "cohort_yield_reference_line": with_common(
        "SELECT *, round(avg(pc_1_year) OVER (), 6) AS overall_mean FROM ("
        + _yields("cohorts", "max_ce_term IN (199540, 199640, 199740)") + ")"
    ),
    "cohort_campus_attach": with_common(
        "SELECT sid, max_ce_term, college, enroll_1_yr, campus, district FROM cohort_campus"
    ),
    "nonenrolled_by_campus": _by("enroll_1_yr = 0 AND max_ce_term NOT IN (199640, 199740)", "campus"),
    "nonenrolled_by_district": _by("enroll_1_yr = 0", "district"),
    "nonenrolled_by_district_spring": _by(
        "enroll_1_yr = 0 AND max_ce_term NOT IN (199640, 199740)", "district"
    ),
    "enrolled_by_campus": _by(f"enroll_1_yr = 1 AND college = {TARGET}", "campus"),
    "enrolled_by_district": _by(f"enroll_1_yr = 1 AND college = {TARGET}", "district"),
    "destination_top_by_cohort": with_common(_top(
        _count(
            f"cohorts WHERE enroll_1_yr = 1 AND max_ce_term > 199540 AND max_ce_term NOT IN ({SUMMERS})",
            "max_ce_term", "college",
        ), 5, "n DESC, college", "max_ce_term",
    )),
    "destination_share_top_by_cohort": with_common(_top(
        _share(
            _count(
                "cohorts WHERE enroll_1_yr = 1 AND max_ce_term IN (199620, 199720, 199740)",
                "max_ce_term", "college",
            ), "pc", "max_ce_term",
        ), 5, "pc DESC, college", "max_ce_term",
    )),
    "destination_share_top": with_common(_top(
        _share(_count("cohorts WHERE enroll_1_yr = 1", "college"), "pc"), 10, "pc DESC, college"
    )),
    "school_student_counts": with_common(_count("ce_full WHERE term > 199540", "term", "high_school", "sid")),
    "campus_student_counts": with_common(_count("ce_full WHERE term > 199540", "term", "campus", "sid")),
    "school_headcount_top": with_common(_top(
        _heads("high_school", f"term > 199520 AND term NOT IN ({SUMMERS})"),
        10, "n DESC, high_school NULLS LAST", "term",
    )),
    "campus_headcount_top": with_common(_top(
        _heads("campus", f"term > 199520 AND term NOT IN ({SUMMERS})"), 10, "n DESC, campus", "term"
    )),
    "school_share_top": _school_share(
        "high_school", f"term > 199540 AND term NOT IN ({SUMMERS})", 20, "drop"
    ),
    "school_share_top_terms": _school_share("high_school", "term IN (199640, 199720)", 20, "drop"),
    "campus_share_top": _school_share("campus", f"term > 199540 AND term NOT IN ({SUMMERS})", 10, ""),
    "campus_share_top_whole": _school_share("campus", "term IN (199640, 199720)", 20, "drop", 0),
    "school_names": with_common(
        "SELECT DISTINCT high_school || ' ' AS school FROM ce_full WHERE high_school <> 'NATION_4'"
    ),
    "crosswalk_attach": with_common("SELECT sid, enroll_id, high_school, district FROM ce_full"),
    "crosswalk_attach_campus": with_common("""
        SELECT sid, enroll_id, campus, r_name AS district FROM ce_full
        LEFT JOIN nation ON campus = n_name LEFT JOIN region ON n_regionkey = r_regionkey"""),
    "crosswalk_attach_zip": with_common("""
        SELECT sid, enroll_id, zip5, n_name AS city, r_name AS region FROM (
            SELECT sid, enroll_id, zip5 FROM ce_full)
        LEFT JOIN nation ON zip5 = 84000 + n_nationkey AND n_nationkey < 20
        LEFT JOIN region ON n_regionkey = r_regionkey"""),
    "campus_district_share": with_common(_share(
        "SELECT term, region AS district, count(DISTINCT sid) AS n FROM ce_full "
        f"WHERE term > 199540 AND term NOT IN ({SUMMERS}) GROUP BY ALL",
        "pc", "term", 100, 1,
    )),
    "district_share": with_common(_share(
        _heads("district", f"term > 199540 AND term NOT IN ({SUMMERS}) AND district IS NOT NULL"),
        "pc", "term", 100, 1,
    )),
    "district_overall": with_common(_share(_count("ce_full", "district"), "pc", "", 100, 1)),
    "campus_overall_top": with_common(
        "SELECT t.*, r_name AS district FROM ("
        + _top(_share(_count("ce_full", "campus"), "pc", "", 100, 1), 20, "n DESC, campus")
        + ") t JOIN nation ON campus = n_name JOIN region ON n_regionkey = r_regionkey"
    ),
    "missing_school_audit": with_common("""
        SELECT term, count(*) AS n, count(*) FILTER (WHERE high_school IS NULL) AS hs_na,
               count(*) * 3 AS sch, count(*) FILTER (WHERE high_school IS NULL) * 3 AS hs_na_sch
        FROM ce_full WHERE term > 199520 GROUP BY term"""),
    "campus_list": with_common(_count("ce_full", "campus")),
    "group_max_attach": with_common(
        "SELECT sid, enroll_id, term, max(term) OVER (PARTITION BY sid) AS max_ce_term FROM ce"
    ),
    "gender_share": _gender("term"),
    "gender_share_by_year": _gender("course_year"),
    "load_by_gender": _load_by("gender", "Unknown"),
    "load_by_ethnicity": _load_by("ethnicity", "FURNITURE"),
    "race_by_term": with_common(_count(
        "(SELECT term, sid, max(ethnicity) AS race FROM ce_full WHERE term > 199540 GROUP BY ALL)",
        "term", "race",
    )),
    "race_share": with_common(
        "SELECT * FROM ("
        + _share(_count(
            "(SELECT sid, max(ethnicity) AS race FROM ce_full WHERE term > 199540 GROUP BY sid)", "race"
        ), "percent")
        + ") WHERE race <> 'FURNITURE'"
    ),
    "race_by_district": with_common(_share(_count("ce_full", "district", "ethnicity"), "pc", "district")),
    "district_by_race": with_common(_share(
        _count("ce_full WHERE ethnicity = 'BUILDING'", "ethnicity", "district"), "pc", "ethnicity"
    )),
    "district_by_race_hidden": with_common(
        "SELECT * FROM ("
        + _share(
            _count("ce_full WHERE ethnicity <> 'FURNITURE'", "ethnicity", "district"), "pc", "ethnicity"
        )
        + ") WHERE district NOT IN ('ASIA', 'EUROPE')"
    ),
    "zip_counts_top": with_common(_top(
        "SELECT zip, count(*) AS n FROM (SELECT sid, max(zip5) AS zip FROM ce_full WHERE term > 199540 "
        "GROUP BY sid) WHERE zip IS NOT NULL GROUP BY zip", 10, "n DESC, zip",
    )),
    "zip_region_top": _zip_region("term > 199540"),
    "zip_region_share_top": _zip_region("term > 199540", shares=True),
    "zip_region_share_top_by_term": _zip_region("term IN (199640, 199720)", "term", True),
    "pell_counts": with_common(_count("ce_full", "pell_eligible")),
    "firstgen_counts": with_common(_count("ce_full", "first_generation")),
    "is_duplicate": with_common("""
        SELECT sid, enroll_id, term, row_number() OVER (
            PARTITION BY sid ORDER BY term, enroll_id) > 1 AS is_duplicate FROM ce"""),
    "frequency_table": with_common(
        _count("(SELECT * FROM ce WHERE hs_grad_year IS NOT NULL)", "hs_grad_year")
    ),
    "fill_where": with_common(
        "SELECT enroll_id, coalesce(ever_nonconcurrent, 'N') AS ever_nonconcurrent FROM ce"
    ),
    "drop_incomplete": with_common("""
        SELECT enroll_id, hs_grad_year, ever_nonconcurrent FROM ce
        WHERE hs_grad_year IS NOT NULL AND ever_nonconcurrent IS NOT NULL"""),
    "labels": with_common("""
        SELECT enroll_id, CAST(term AS VARCHAR) || coalesce(ever_nonconcurrent, 'NA') AS term_key,
               substr(inst_id, 2) AS bare_id FROM ce"""),
}
