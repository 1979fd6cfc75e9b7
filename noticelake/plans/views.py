"""Record-shaped views over the driver tables. Each text runs unchanged on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REC_ID = "concat_ws('-', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING), CAST(l.l_partkey AS STRING), CAST(l.l_suppkey AS STRING), CAST(CAST(l.l_shipdate AS DATE) AS STRING))"

VIEWS = {
    # evidence of three source kinds
    "rec": f"""SELECT {REC_ID} AS rec_id,
  CASE l.l_returnflag WHEN 'A' THEN 'authority' WHEN 'N' THEN 'municipality' ELSE 'import' END AS source_kind,
  concat('ref-', CAST(l.l_orderkey % 5000 AS STRING)) AS source_reference,
  concat('Town ', CAST(s.s_nationkey AS STRING), CASE WHEN l.l_linenumber % 3 = 0 THEN ' (AG)' ELSE '' END) AS municipality,
  CASE WHEN l.l_linenumber = 7 THEN '' ELSE CAST(CAST(date_trunc('month', l.l_shipdate) AS DATE) AS STRING) END AS publication_date,
  CASE WHEN l.l_linenumber = 6 THEN '' ELSE CAST(CAST(l.l_shipdate AS DATE) AS STRING) END AS deadline_date,
  CASE WHEN l.l_quantity > 25 THEN concat('Parzelle ', CAST(l.l_partkey AS STRING)) ELSE '' END AS parcel,
  concat(CASE WHEN l.l_linenumber % 2 = 0 THEN 'Bahnhofstrasse ' ELSE 'Bahnhofstr. ' END, CAST(l.l_partkey AS STRING)) AS address,
  p.p_name AS project_type,
  CASE o.o_orderstatus WHEN 'F' THEN 'archived' WHEN 'P' THEN 'under-review' ELSE 'new' END AS workflow_status,
  l.l_shipdate AS observed_at
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey
JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    # stored records with their review state
    "app": f"""SELECT {REC_ID} AS id, concat('src-', CAST(l.l_suppkey % 13 AS STRING)) AS source,
  concat('ref-', CAST(l.l_orderkey % 5000 AS STRING)) AS source_reference,
  concat('Town ', CAST(s.s_nationkey AS STRING)) AS municipality, concat('Bahnhofstrasse ', CAST(l.l_partkey AS STRING)) AS address,
  p.p_name AS project_type, p.p_type AS description,
  CAST(l.l_shipdate AS DATE) AS publication_date,
  CASE WHEN l.l_linenumber = 6 THEN NULL ELSE CAST(l.l_shipdate AS DATE) + CAST(l.l_quantity AS INTEGER) END AS deadline_date,
  CASE l.l_partkey % 5 WHEN 0 THEN 'no-hit' WHEN 1 THEN 'protected-point' WHEN 2 THEN 'protected-zone' WHEN 3 THEN 'combined-hit' ELSE 'manual-review' END AS protection_status,
  CASE l.l_suppkey % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'under-review' WHEN 2 THEN 'cleared' ELSE 'archived' END AS workflow_status,
  CASE l.l_orderkey % 9 WHEN 0 THEN 'ambiguous-review' WHEN 1 THEN 'conflict-review' WHEN 2 THEN 'missing-publication' WHEN 3 THEN 'import-review'
    WHEN 4 THEN 'unclear' WHEN 5 THEN 'ambiguous' WHEN 6 THEN 'municipality-only' WHEN 7 THEN NULL ELSE 'authority-confirmed' END AS reconciliation_status,
  l.l_partkey % 7 = 0 AS ambiguous_address, CASE WHEN l.l_suppkey % 10 = 0 THEN 'team' ELSE '' END AS assignee,
  CASE WHEN l.l_partkey % 11 = 0 THEN 'checked' ELSE '' END AS note,
  CASE WHEN l.l_linenumber <= 2 THEN 'authority' ELSE 'municipality' END AS source_kind,
  l.l_linenumber AS line_no, l.l_shipdate AS created_at
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey""",
    # labelled notice texts
    "txt": f"""SELECT {REC_ID} AS txt_id, concat('Baugesuch Bauherrschaft: Muster AG Bauvorhaben: ', p.p_name, ' Bauplatz: Bahnhofstrasse ', CAST(l.l_linenumber * 3 AS STRING),
 ', Parzelle Nr. ', CAST(l.l_partkey AS STRING), ' Auflage vom ', CAST(day(l.l_shipdate) AS STRING), '.', CAST(month(l.l_shipdate) AS STRING), '.',
 ' bis ', CAST(day(l.l_shipdate) AS STRING), '.', CAST(month(l.l_shipdate) AS STRING), '.20', lpad(CAST(year(l.l_shipdate) % 30 AS STRING), 2, '0')) AS body,
 l.l_linenumber AS line_no
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    # notice texts of which some lack a part
    "ntx": f"""SELECT {REC_ID} AS txt_id, l.l_linenumber AS line_no, CAST(l.l_partkey AS STRING) AS part, CASE l.l_linenumber
 WHEN 2 THEN concat('Baugesuch Bauvorhaben: ', p.p_name, ' Bauplatz: unbekannt, Parzelle Nr. ', CAST(l.l_partkey AS STRING), ' Auflage vom 1.2.2024 bis 3.3.2024')
 WHEN 3 THEN concat('Baugesuch Bauvorhaben: ', p.p_name, ' Bauplatz: Dorfgasse ', CAST(l.l_partkey AS STRING))
 WHEN 4 THEN concat('Einladung zum Markt an der Dorfgasse ', CAST(l.l_partkey AS STRING), ' vom 1. Februar bis 3. März 2024')
 WHEN 5 THEN ''
 ELSE concat('Baugesuch Bauvorhaben: ', p.p_name, ' Bauplatz: Dorfgasse ', CAST(l.l_partkey AS STRING), ', Parzelle Nr. ', CAST(l.l_partkey AS STRING), ' Auflage vom 1. Februar bis 3. März 2024') END AS body, p.p_name AS p_name
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    # notice pages: labelled blocks, a permit table, another table, links, or nothing but a title
    "npg": """SELECT page_id, url, CASE page_id % 6
 WHEN 0 THEN concat('<h1>Auflage</h1><p>Bauherrschaft: Muster ', CAST(page_id AS STRING), ' Bauvorhaben: Garage ', CAST(page_id AS STRING), ' Bauplatz: Weg ', CAST(page_id AS STRING),
  ' Parzelle 7</p><p>Gesuchsteller: Meier Bauobjekt: Dach Standort: Gasse 2</p><p>Bauherrschaft: Keller zurückgezogen Bauvorhaben: Haus Bauplatz: Weg 3</p><p>Bauherr: Frei Bauvorhaben: ohne Ort</p>')
 WHEN 1 THEN concat('<title>Gesuche</title><table><tr></tr><tr><th>Baugesuch Nr</th><th>Bauherrschaft</th><th>Bauplatz</th><th>Bauvorhaben</th></tr><tr><td>', CAST(page_id AS STRING),
  '</td><td>Muster &amp; Co</td><td>Weg ', CAST(page_id AS STRING), '</td><td>Stall</td></tr><tr><td>2</td><td> </td><td>x</td></tr><tr><td>3</td><td>Rot</td><td>Gasse 4</td><td>Pergola</td></tr></table>')
 WHEN 2 THEN concat('<title>Seite ', CAST(page_id AS STRING), '</title><table><tr><th>Datum</th><th>Anlass</th><th>Ort</th></tr><tr><td>1.1.</td><td>Markt</td><td>Platz</td></tr></table>')
 WHEN 3 THEN concat('<title>Seite ', CAST(page_id AS STRING), '</title><p>Bauherrschaft gesucht</p>')
 ELSE html END AS html FROM pages""",
    # sites of eight pages: a start page with links, and what they lead to
    "site": """SELECT page_id, CAST(floor(page_id / 8.0) AS BIGINT) AS site, page_id % 8 AS place, CASE WHEN page_id % 8 = 5 THEN 403 WHEN page_id % 8 = 7 AND page_id % 3 = 0 THEN 500 ELSE 200 END AS http_status,
 concat('https://g', CAST(CAST(floor(page_id / 8.0) AS BIGINT) AS STRING), '.example.ch', CASE page_id % 8 WHEN 0 THEN '/' WHEN 1 THEN '/baugesuche' WHEN 2 THEN '/amtliche-publikationen' WHEN 3 THEN '/news-detail/7-baugesuch'
  WHEN 4 THEN '/kontakt' WHEN 5 THEN '/publikation/archiv' WHEN 6 THEN '/aktuelles' ELSE '/portal' END) AS url,
 CASE page_id % 8 WHEN 0 THEN '<title>Gemeinde</title><ul><li><a href="/baugesuche">Baugesuche</a> Rubrik</li><li><a href="/amtliche-publikationen">Amtliche Publikationen</a></li><li><a href="/news-detail/7-baugesuch">Baugesuch Meier</a></li><li><a href="/kontakt">Baugesuch</a></li><li><a href="/aktuelles">Kontakt zum Baugesuch</a></li><li><a href="https://other.example.ch/baugesuche">Baugesuche</a></li></ul><p>Siehe <a href="publikation/archiv#top">Archiv</a> der Publikation</p>'
  WHEN 1 THEN CASE CAST(floor(page_id / 8.0) AS BIGINT) % 3 WHEN 0 THEN '<title>Baugesuche</title><main><p>Baugesuche: Bauherrschaft Muster, Parzelle 1. Rubrik</p><a href="/d/1">Baugesuch 1</a><a href="/d/2">Baugesuch 2</a></main>'
   WHEN 1 THEN '<title>Baugesuche</title><p>Erteilte Baubewilligungen</p>' ELSE '<title>x</title><p>Seite im Aufbau</p>' END
  WHEN 2 THEN '<title>Amtlich</title><p>Amtliche Publikationen, öffentliche Auflage vom 1.1.</p>' WHEN 3 THEN '<title>Baugesuch Meier</title><p>Bauplatz Weg 1, Parzelle 3</p>'
  WHEN 4 THEN '<title>Kontakt</title><p>Newsletter und Agenda</p>' WHEN 5 THEN '<title>Archiv</title><p>Baupublikation</p>' WHEN 6 THEN concat('<title>Aktuelles</title><p>', CAST(page_id AS STRING), '</p>')
  ELSE '<title>Portal</title><p>Anmeldung erforderlich für eBau</p>' END AS html FROM pages""",
    "gpt": """SELECT c_custkey AS pt_id, CAST(2600000.0 + (c_custkey * 7919) % 50000 AS DOUBLE) AS east, CAST(1200000.0 + (c_custkey * 104729) % 40000 AS DOUBLE) AS north,
 CASE WHEN c_nationkey % 4 = 0 THEN 'approximate' ELSE 'precise' END AS location_precision FROM customer""",
    "gar": """SELECT s_suppkey AS area_id, CASE s_suppkey % 3 WHEN 0 THEN 21 WHEN 1 THEN 15 ELSE 20 END AS layer_id,
 CAST(2600000.0 + (s_suppkey * 31337) % 50000 AS DOUBLE) AS x0, CAST(1200000.0 + (s_suppkey * 27644437) % 40000 AS DOUBLE) AS y0 FROM supplier""",
    # point features: buildings of an inventory
    "gbl": """SELECT p_partkey AS feature_id, CAST(2600000.0 + (p_partkey * 6007) % 50000 AS DOUBLE) AS fx, CAST(1200000.0 + (p_partkey * 51971) % 40000 AS DOUBLE) AS fy FROM part""",
    "cat_link": """SELECT s_nationkey AS municipality_id, min(s_suppkey) AS source_id, 'primary' AS relation_type FROM supplier GROUP BY s_nationkey
UNION ALL
SELECT n_nationkey, s_suppkey, 'supplemental' FROM nation CROSS JOIN supplier WHERE s_suppkey % 10 = 0""",
    "cat_source": """SELECT s_suppkey AS source_id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'shared-publication' WHEN 1 THEN 'municipality-direct' WHEN 2 THEN 'municipality-listing' ELSE 'manual' END AS source_kind,
  s_suppkey % 10 = 0 AS is_shared, concat('https://', lower(replace(s_name, '#', '-')), '.example.ch/baugesuche') AS canonical_url FROM supplier""",
    "cat_quality": """SELECT l.municipality_id, l.source_id AS primary_source_id,
  CASE WHEN s.s_acctbal > 6000 THEN 'A' WHEN s.s_acctbal > 3000 THEN 'B' WHEN s.s_acctbal > 0 THEN 'C' ELSE 'D' END AS rating, s.s_acctbal <= 3000 AS uncertain
FROM cat_link l JOIN supplier s ON s.s_suppkey = l.source_id WHERE l.relation_type = 'primary'""",
    "lrn": """SELECT o.o_orderkey AS decision_id, lower(replace(n.n_name, '_', ' ')) AS municipality_key, concat('bahnhofstr ', CAST(o.o_custkey % 20 AS STRING)) AS address_signature,
  lower(replace(c.c_mktsegment, '_', ' ')) AS project_signature,
  CASE o.o_orderstatus WHEN 'F' THEN 'no-hit' WHEN 'P' THEN 'protected-point' ELSE 'protected-zone' END AS protection_status,
  o.o_orderdate AS decided_at FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""",
}
NEEDS = {"cat_quality": ["cat_link"]}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """Base tables and views of one data folder as DataFrames: t.orders, t.rec, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.held = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        if name not in self.held:
            if name in VIEWS:
                used = [x for x in [*TABLES, *NEEDS.get(name, [])] if f" {x}" in VIEWS[name]]
                for x in used:
                    getattr(self, x).createOrReplaceTempView(x)
                self.held[name] = self.spark.sql(VIEWS[name])
            else:
                self.held[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.held[name]


def with_views(body: str, *names: str) -> str:
    """SQL with the named views in front."""
    every = [x for n in names for x in [*NEEDS.get(n, []), n]]
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in dict.fromkeys(every))
    body = body.strip()
    if not heads:
        return body
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
