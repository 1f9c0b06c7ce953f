"""The same domain inputs as SQL, for checking results with an independent engine."""

from __future__ import annotations

MONTHS = "((year({b}) - year({a})) * 12 + month({b}) - month({a}) - CASE WHEN day({b}) < day({a}) THEN 1 ELSE 0 END)"

# whole months a -> b, truncated toward zero
SIGNED_MONTHS = (
    "(CASE WHEN {b} >= {a} THEN " + MONTHS + " ELSE -" + MONTHS.replace("{a}", "{x}").replace("{b}", "{a}").replace("{x}", "{b}") + " END)"
)


def months(a: str, b: str) -> str:
    return MONTHS.format(a=a, b=b)


def signed_months(a: str, b: str) -> str:
    return SIGNED_MONTHS.format(a=a, b=b)


PARTS: dict[str, tuple[list[str], str]] = {
    "permits": (
        [],
        """
        SELECT o_orderkey AS gta_id, CAST(o_orderdate AS DATE) AS gta_date, CAST(year(o_orderdate) AS INTEGER) AS year,
               o_orderstatus = 'F' AS slaughter_gta, o_custkey * 2 AS origin_id,
               CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % (SELECT count(*) FROM supplier)) * 2 + 1
                    ELSE ((o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM customer)) * 2 END AS dest_id,
               CASE WHEN o_orderstatus = 'F' THEN 'Slaughterhouse' ELSE 'Farm' END AS dest_label
        FROM orders""",
    ),
    "animals": (
        [],
        """
        SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER),
                   CAST(round(l_extendedprice * 100) AS BIGINT), CAST(CAST(l_shipdate AS DATE) AS VARCHAR))) AS line_id,
               l_orderkey AS gta_id,
               concat('BOVINO,', CASE WHEN l_linestatus = 'F' THEN 'FEMEA' ELSE 'MACHO' END, ',',
                   CASE WHEN p_size <= 12 THEN '0 A 12 MESES' WHEN p_size <= 24 THEN '13 A 24 MESES'
                        WHEN p_size <= 36 THEN '25 A 36 MESES' ELSE 'ACIMA DE 36 MESES' END) AS description,
               CAST(l_quantity AS INTEGER) AS amount
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    ),
    "totals": (
        ["permits"],
        """
        SELECT p.*, CAST(coalesce(t.n, 0) AS BIGINT) AS total_animals
        FROM permits p LEFT JOIN (
            SELECT l_orderkey, sum(CAST(l_quantity AS INTEGER)) AS n FROM lineitem GROUP BY 1) t ON p.gta_id = t.l_orderkey""",
    ),
    "flows": (
        ["totals"],
        "SELECT origin_id AS src, dest_id AS dst, dest_label AS dst_label, CAST(sum(total_animals) AS BIGINT) AS total_sent, "
        + ", ".join(
            f"CAST(sum(CASE WHEN year = {y} THEN total_animals ELSE 0 END) AS BIGINT) AS total_{y}" for y in range(1995, 2002)
        )
        + " FROM totals GROUP BY 1, 2, 3",
    ),
    "grp": (
        ["permits", "animals"],
        """
        SELECT line_id AS id, origin_id, dest_id, dest_label, amount, sex, lower_age,
               CASE WHEN lower_age = upper_age THEN 42 ELSE upper_age END AS upper_age,
               description, gta_date AS transport_date, year AS transport_year, gta_id AS related_gta
        FROM (SELECT a.*, p.* EXCLUDE (gta_id), regexp_extract(description, ',([^,]+),', 1) AS sex,
                     CAST(regexp_extract(description, '^[^\\d]*(\\d+)', 1) AS INTEGER) AS lower_age,
                     CAST(regexp_extract(description, '(\\d+)[^\\d]*$', 1) AS INTEGER) AS upper_age
              FROM animals a JOIN permits p ON a.gta_id = p.gta_id)""",
    ),
    "ccf": (
        ["grp"],
        f"""
        SELECT ag1, ag2, least(amount1, amount2) AS possible_animals,
               least(high1, high2 + aged) - greatest(low1, low2 + aged) + 1 AS month_intersection,
               ag1_dest_id, ag1_year, farm_id, ag2_origin_id
        FROM (SELECT x.id AS ag1, y.id AS ag2, x.amount AS amount1, y.amount AS amount2, x.lower_age AS low1, x.upper_age AS high1,
                     y.lower_age AS low2, y.upper_age AS high2, x.dest_id AS ag1_dest_id, x.transport_year AS ag1_year,
                     x.origin_id AS farm_id, y.origin_id AS ag2_origin_id,
                     CAST({months("y.transport_date", "x.transport_date")} AS INTEGER) AS aged
              FROM grp x JOIN grp y ON x.origin_id = y.dest_id AND x.sex = y.sex
              WHERE y.dest_label = 'Farm' AND x.id <> y.id AND x.transport_date >= y.transport_date)
        WHERE low2 + aged <= high1 AND high2 + aged >= low1""",
    ),
    "arriving": (
        ["grp"],
        "SELECT * FROM grp WHERE dest_id = 1 AND transport_year IN (1998, 1997)",
    ),
    "first_deg": (
        ["arriving"],
        """
        SELECT origin_id AS farm_id, transport_year AS year, CAST(sum(amount) AS BIGINT) AS first_degree
        FROM arriving GROUP BY 1, 2""",
    ),
    "second_deg": (
        ["ccf"],
        """
        SELECT farm_id, year, CAST(sum(best) AS BIGINT) AS second_degree
        FROM (SELECT ag1, ag1_year AS year, ag2_origin_id AS farm_id, max(possible_animals) AS best
              FROM ccf WHERE ag1_dest_id = 1 AND ag1_year IN (1998, 1997) GROUP BY 1, 2, 3)
        GROUP BY 1, 2""",
    ),
    "third_deg": (
        ["ccf"],
        """
        SELECT farm_id, year, CAST(sum(best) AS BIGINT) AS third_degree
        FROM (SELECT a.ag1, a.ag1_year AS year, b.ag2_origin_id AS farm_id,
                     least(max(a.possible_animals), max(b.possible_animals)) AS best
              FROM ccf a JOIN ccf b ON a.ag2 = b.ag1
              WHERE a.ag1_dest_id = 1 AND a.ag1_year IN (1998, 1997) GROUP BY 1, 2, 3)
        GROUP BY 1, 2""",
    ),
    "shed": (
        ["first_deg", "second_deg", "third_deg"],
        "SELECT farm_id, "
        + ", ".join(
            (f"coalesce(max(CASE WHEN year = {y} THEN {d} END), 0)" if (y, d) == (1998, "first_degree") else f"max(CASE WHEN year = {y} THEN {d} END)")
            + f" AS {d}_{y}"
            for y in (1998, 1997)
            for d in ("first_degree", "second_degree", "third_degree")
        )
        + """
        FROM (SELECT farm_id, year, first_degree, NULL::BIGINT AS second_degree, NULL::BIGINT AS third_degree FROM first_deg
              UNION ALL SELECT farm_id, year, NULL, second_degree, NULL FROM second_deg
              UNION ALL SELECT farm_id, year, NULL, NULL, third_degree FROM third_deg)
        GROUP BY 1""",
    ),
    "reached": (
        ["flows"],
        """
        SELECT id, min(hops) AS hops FROM (
            WITH RECURSIVE r(id, hops) AS (
                SELECT src, 1 FROM flows WHERE dst = 1
                UNION
                SELECT f.src, r.hops + 1 FROM r JOIN flows f ON f.dst = r.id WHERE r.hops < 4)
            SELECT * FROM r) GROUP BY 1""",
    ),
    "nodes": (
        [],
        """
        SELECT c_custkey * 2 AS id, CAST(c_custkey AS VARCHAR) AS tax_number, c_name AS name, 'Farm' AS label FROM customer
        UNION ALL SELECT s_suppkey * 2 + 1, CAST(s_suppkey AS VARCHAR), s_name, 'Slaughterhouse' FROM supplier""",
    ),
    "share": (
        ["flows"],
        """
        SELECT src, dst, 0.85 * total_sent / s AS share
        FROM flows JOIN (SELECT src AS sender, sum(total_sent) AS s FROM flows GROUP BY 1) ON src = sender WHERE s > 0""",
    ),
    "first_edge": (
        ["flows"],
        "SELECT dst AS src, src AS dst, total_1998 AS total FROM flows WHERE dst_label = 'Slaughterhouse' AND total_1998 > 0",
    ),
    "marked": (
        ["grp"],
        f"""
        SELECT *, transport_year = 1998 OR {signed_months("transport_date", "DATE '1998-12-31'")} + lower_age < 42 AS possible_source
        FROM grp WHERE dest_label = 'Farm'""",
    ),
    "next_edge": (
        ["marked"],
        "SELECT dest_id AS src, origin_id AS dst, CAST(sum(amount) AS BIGINT) AS total FROM marked WHERE possible_source GROUP BY 1, 2",
    ),
    "path_edge": (
        ["first_edge", "next_edge"],
        """
        SELECT src, dst, 1.0::DOUBLE / (total + 1) AS w FROM first_edge
        UNION ALL SELECT src, dst, 1.0::DOUBLE / (total + 1) FROM next_edge WHERE src <> dst""",
    ),
    "tree": (
        ["path_edge"],
        """
        SELECT * FROM (
            WITH RECURSIVE sp(source, target, cost, hops, pred) USING KEY (source, target) AS (
                SELECT s_suppkey * 2 + 1, s_suppkey * 2 + 1, 0.0::DOUBLE, 0, NULL::BIGINT FROM supplier
                UNION
                SELECT c.source, c.target, c.m.cost, c.m.hops, c.m.pred
                FROM (SELECT f.source, e.dst AS target, min({'cost': f.cost + e.w, 'hops': f.hops + 1, 'pred': e.src}) AS m
                      FROM sp f JOIN path_edge e ON e.src = f.target GROUP BY 1, 2) c
                LEFT JOIN recurring.sp r ON r.source = c.source AND r.target = c.target
                WHERE c.source <> c.target
                  AND (r.target IS NULL OR c.m < {'cost': r.cost, 'hops': r.hops, 'pred': r.pred}))
            SELECT * FROM sp)""",
    ),
    "raw": (
        [],
        """
        SELECT CAST(o_orderkey AS VARCHAR) AS gta_id, CAST(o_orderdate AS DATE) AS gta_date,
               CAST(year(o_orderdate) AS INTEGER) AS year,
               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderstatus = 'F' END AS slaughter_gta,
               concat('Farm:', length(o.tax), ':', o.tax, ':', o.name) AS origin_id, o.tax AS origin_tax, o.name AS origin_name,
               o.geocode AS origin_geocode, concat(o.nation, '-', o_orderstatus) AS origin_city, o.state AS origin_state,
               concat('F-', o.tax) AS origin_code,
               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN concat(CASE WHEN o_orderstatus = 'F' THEN 'Slaughterhouse:' ELSE 'Farm:' END,
                                                                         length(d.tax), ':', d.tax, ':', d.name) END AS dest_id,
               CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
                    THEN CASE WHEN o_orderstatus = 'F' THEN 'Slaughterhouse' ELSE 'Farm' END END AS dest_label,
               d.tax AS dest_tax, d.name AS dest_name, d.geocode AS dest_geocode,
               concat(d.nation, '-', o_orderstatus) AS dest_city, d.state AS dest_state,
               concat(CASE WHEN o_orderstatus = 'F' THEN 'S-' ELSE 'F-' END, d.tax) AS dest_code,
               o_orderpriority AS transport, o_orderstatus AS purpose, o.state AS gta_source, 'BOVINO' AS species,
               CAST(o_orderkey % 40 + 1 AS INTEGER) AS amount0, CAST(o_custkey % 25 AS INTEGER) AS amount1, o_orderkey
        FROM orders
        JOIN (SELECT c_custkey AS key, CAST(c_custkey AS VARCHAR) AS tax, c_name AS name, CAST(c_nationkey AS VARCHAR) AS geocode,
                     n_name AS nation, r_name AS state
              FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) o ON o.key = o_custkey
        JOIN (SELECT c_custkey AS key, false AS s, CAST(c_custkey AS VARCHAR) AS tax, c_name AS name,
                     CAST(c_nationkey AS VARCHAR) AS geocode, n_name AS nation, r_name AS state
              FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
              UNION ALL
              SELECT s_suppkey, true, CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), n_name, r_name
              FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) d
          ON d.s = (o_orderstatus = 'F')
         AND d.key = CASE WHEN o_orderstatus = 'F' THEN o_orderkey % (SELECT count(*) FROM supplier)
                          ELSE (o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM customer) END""",
    ),
    "dest_orders": (
        [],
        """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 10 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
        FROM orders WHERE o_orderkey % 10 <> 0
        UNION ALL
        SELECT o_orderkey + 1000000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        FROM orders WHERE o_orderkey % 10 = 2
        UNION ALL SELECT orders.* FROM orders, range(2) WHERE o_orderkey % 10 = 4""",
    ),
    "source_orders": (
        [],
        "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 3",
    ),
    "ponds": (
        [],
        """
        SELECT concat('POND-', c_custkey) AS pond,
               CASE WHEN NOT (c_mktsegment = 'MACHINERY' AND c_nationkey = 3) THEN concat('EC-', c_nationkey) END AS parish,
               c_acctbal + 1000 AS area
        FROM customer""",
    ),
    "exports": (
        [],
        """
        SELECT CAST(year(l_shipdate) AS VARCHAR) AS YEAR,
               ['030616', '030617', '030635', '030636', '030695', '160521', '160529', '030611', '160510'][l_partkey % 9 + 1] AS hs6,
               CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) / 1000 AS volume_raw
        FROM lineitem WHERE l_partkey % 9 < 7""",
    ),
    "parish_year": (
        ["ponds", "exports"],
        """
        SELECT parish AS PARISH_TRASE_ID, y.YEAR AS YEAR,
               coalesce(x.total, 0) / 0.95 / (SELECT sum(area) FROM ponds) * p.area AS avg_produced_tons, p.area AS AREA_HA
        FROM (SELECT parish, sum(area) AS area FROM ponds WHERE parish IS NOT NULL GROUP BY 1) p
        CROSS JOIN (SELECT CAST(unnest(range(1995, 2002)) AS VARCHAR) AS YEAR) y
        LEFT JOIN (SELECT YEAR, sum(volume_raw) AS total FROM exports GROUP BY 1) x ON x.YEAR = y.YEAR""",
    ),
    "city_nation": (
        [],
        "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "listed": (
        [],
        """
        SELECT CASE s_suppkey % 3 WHEN 0 THEN concat('PPA-', k) WHEN 1 THEN concat('PA-', k) ELSE CAST(k AS VARCHAR) END AS CODE,
               s_name AS NAME, concat('CALLE  ', s_nationkey) AS ADDRESS, concat('04-', s_suppkey) AS TELEPHONE,
               concat('SR ', s_name) AS CONTACT, s_suppkey AS row_id, source_rank
        FROM (SELECT *, s_suppkey AS k, 0 AS source_rank FROM supplier WHERE s_nationkey < 15
              UNION ALL SELECT *, s_suppkey, 1 FROM supplier WHERE s_nationkey >= 10
              UNION ALL SELECT *, s_suppkey + 1000000000, 2 FROM supplier WHERE s_acctbal < 0
              UNION ALL SELECT *, s_suppkey, 1000 FROM supplier WHERE s_acctbal >= 0
              UNION ALL SELECT *, s_suppkey, 1001 FROM supplier WHERE s_acctbal < 0)""",
    ),
    "facilities": (
        ["listed"],
        """
        SELECT * FROM listed WHERE source_rank >= 2
        UNION ALL
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY CODE, NAME, ADDRESS, CONTACT ORDER BY source_rank, row_id) AS rn
            FROM listed WHERE source_rank < 2) WHERE rn = 1""",
    ),
    "eu": (
        ["city_nation"],
        """
        SELECT CASE WHEN s_acctbal > 9000 THEN concat('X-', s_suppkey) ELSE CAST(s_suppkey AS VARCHAR) END AS CODE,
               CAST(s_suppkey AS INTEGER) AS simple, upper(s_name) AS NAME,
               CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS CITY, r_name AS REGION, 'PP' AS COMMENT
        FROM supplier JOIN city_nation ON s_nationkey = n_nationkey WHERE s_nationkey % 2 = 0""",
    ),
    "china": (
        ["city_nation"],
        """
        SELECT CAST(s_suppkey AS INTEGER) AS code, concat('CN ', s_name) AS NAME, lower(n_name) AS county,
               ['A', 'A - FISHERY PRODUCTS', 'FISHERY PRODUCTS', 'AQUACULTURE PRODUCTS/FISHERY PRODUCTS',
                'AQUACULTURE PRODUCTS', 'A - AQUACULTURE PRODUCTS', 'OTHER'][s_suppkey % 7 + 1] AS Remark
        FROM supplier JOIN city_nation ON s_nationkey = n_nationkey WHERE s_nationkey % 5 < 3""",
    ),
    "city_par": (
        ["city_nation"],
        """
        SELECT p.id AS PARISH_TRASE_ID, c.CITY, c.REGION, c.CANTON
        FROM (SELECT concat(n_name, '_P') AS PARISH, CASE WHEN r_regionkey <> 0 THEN r_name END AS CANTON,
                     CASE WHEN n_nationkey <> 24 THEN n_name END AS CITY, r_name AS REGION FROM city_nation) c
        LEFT JOIN (SELECT concat(n_name, '_P') AS PARISH, CASE WHEN r_regionkey <> 0 THEN r_name END AS CANTON,
                          concat('EC-', n_nationkey) AS id FROM city_nation WHERE n_nationkey % 4 <> 1) p
          ON p.PARISH IS NOT DISTINCT FROM c.PARISH AND p.CANTON IS NOT DISTINCT FROM c.CANTON""",
    ),
    "matched": (
        ["facilities", "eu", "china", "city_par"],
        """
        SELECT f.CODE, f.NAME, f.ADDRESS, f.TELEPHONE, f.CONTACT, f.simple AS SIMPLE_CODE, f.CITY, c.PARISH_TRASE_ID, f.REGION, c.CANTON,
               f.EU_NAME_SYNONYM, f.EU_TYPE, f.EU_CERTIFIED, f.CHINA_NAME_SYNONYM, f.CHINA_CERTIFIED,
               CASE WHEN f.CODE LIKE 'PPA-%' THEN 'F Aq' ELSE 'Aq' END AS TYPE, f.source_rank, f.row_id
        FROM (SELECT b.*, coalesce(e.CITY, upper(h.county)) AS CITY, e.REGION, e.NAME AS EU_NAME_SYNONYM, e.COMMENT AS EU_TYPE,
                     CASE WHEN e.CODE IS NULL THEN 'FALSE' ELSE 'TRUE' END AS EU_CERTIFIED, h.NAME AS CHINA_NAME_SYNONYM,
                     CASE WHEN h.code IS NULL THEN 'FALSE' ELSE 'TRUE' END AS CHINA_CERTIFIED
              FROM (SELECT *, CAST(regexp_extract(CODE, '([0-9]+)$', 1) AS INTEGER) AS simple FROM facilities) b
              LEFT JOIN eu e ON b.simple = e.simple LEFT JOIN china h ON b.simple = h.code) f
        LEFT JOIN city_par c ON f.CITY IS NOT DISTINCT FROM c.CITY""",
    ),
}


def sql(body: str, *parts: str, recursive: bool = False) -> str:
    """`body` preceded by the named inputs and all they need, each once."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in PARTS[name][0]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for part in parts:
        need(part)
    if not ordered:
        return body
    texts = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name][1]})" for name in ordered)
    return f"WITH {'RECURSIVE ' if recursive else ''}{texts}\n{body}"
