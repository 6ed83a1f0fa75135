"""Queries over the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators import quality as Q
from corpusloom.plans.compile_queries import COMP, MD, PROV, compiled
from corpusloom.plans.registry import query

_SLUG = "regexp_replace(replace(regexp_replace(trim(title), '[<>:\"/\\\\|?*\\x00-\\x1f]', '', 'g'), ' ', '-'), '-{2,}', '-', 'g')"
_BARE = f"regexp_replace(regexp_replace({_SLUG}, '^-+', ''), '-+$', '')"
SLUG = f"CASE WHEN {_BARE} = '' THEN trim(title) ELSE {_BARE} END"
GRAPH = f"""{COMP}, nod AS (SELECT src_id AS id, title AS label, 'source' AS node_type FROM comp UNION ALL SELECT DISTINCT 'concept:' || name, name, 'concept' FROM con UNION ALL SELECT DISTINCT 'summary:' || ({SLUG}), {SLUG}, 'summary' FROM comp),
dm AS (SELECT DISTINCT name, src_id FROM con), cls AS (SELECT name, count(*) AS sources, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS links FROM dm GROUP BY name HAVING count(*) > 1), rc AS (SELECT src_id, CAST(sum(sources - 1) AS BIGINT) AS links FROM dm JOIN cls USING (name) GROUP BY src_id),
byt AS (SELECT type AS k, src_id, row_number() OVER (PARTITION BY type ORDER BY src_id) AS r FROM (SELECT DISTINCT type, src_id FROM comp)),
edg AS (SELECT src_id AS source, 'summary:' || ({SLUG}) AS target, 'compiled_to' AS relation, 1.0::DOUBLE AS weight FROM comp UNION ALL SELECT src_id, 'concept:' || name, 'contains_concept', 1.0::DOUBLE FROM dm
 UNION ALL SELECT x.src_id, y.src_id, 'same_type', 0.1::DOUBLE FROM byt x JOIN byt y ON x.k = y.k AND x.r < y.r WHERE x.r <= 50 AND y.r <= 50),
nb AS (SELECT source AS id, target AS neighbour, relation, weight FROM edg UNION ALL SELECT target, source, 'reverse_' || relation, weight FROM edg),
rel AS (SELECT DISTINCT x.src_id AS id, y.src_id AS neighbour, CASE WHEN x.src_id < y.src_id THEN 'related_to' ELSE 'reverse_related_to' END AS relation, 0.3::DOUBLE AS weight FROM dm x JOIN dm y ON x.name = y.name AND x.src_id <> y.src_id)"""


def graph(spark, sf_dir):
    comp = compiled(spark, sf_dir)
    return G.nodes(comp), G.edges(comp)


@query(f"WITH {GRAPH} SELECT id, label, node_type FROM nod")
def graph_nodes(spark, sf_dir):
    return G.nodes(compiled(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT source, target, relation, weight FROM edg")
def graph_edges(spark, sf_dir):
    """All edges but related_to, whose links graph_mentions and graph_related give in whole as classes."""
    return G.edges(compiled(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT name, src_id, sources, links FROM dm JOIN cls USING (name)")
def graph_mentions(spark, sf_dir):
    """The classes of sources that share a concept, member by member: every two of a class are linked."""
    comp = compiled(spark, sf_dir)
    return G.mentions(comp).join(G.mention_classes(comp), "name").select("name", "src_id", "sources", "links")


@query(f"WITH {GRAPH} SELECT src_id, links FROM rc")
def graph_related(spark, sf_dir):
    return G.related_counts(compiled(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT 'node' AS kind, node_type AS name, count(*) AS n FROM nod GROUP BY node_type UNION ALL SELECT 'edge', relation, count(*) FROM edg GROUP BY relation UNION ALL SELECT 'edge', 'related_to', CAST(sum(links) AS BIGINT) FROM cls HAVING sum(links) > 0")
def graph_stats(spark, sf_dir):
    return G.stats(*graph(spark, sf_dir), G.mention_classes(compiled(spark, sf_dir)))


@query(f"WITH {GRAPH} SELECT id, CAST(sum(n) AS BIGINT) AS degree FROM (SELECT source AS id, 1 AS n FROM edg UNION ALL SELECT target, 1 FROM edg UNION ALL SELECT src_id, links FROM rc) GROUP BY id ORDER BY degree DESC, id LIMIT 10")
def graph_top_connected(spark, sf_dir):
    """The ten best connected nodes: the limit is the feature."""
    return G.degrees(graph(spark, sf_dir)[1], G.related_counts(compiled(spark, sf_dir))).orderBy(F.desc("degree"), "id").limit(10)


@query(f"""WITH {GRAPH} SELECT id, label, CAST(CASE WHEN lower(label) = 'that' THEN 2 ELSE 1 END AS INTEGER) AS score FROM nod WHERE contains(lower(label), 'that') OR contains(lower(id), 'that') ORDER BY score DESC, id LIMIT 20""")
def graph_search(spark, sf_dir):
    """The first 20 nodes for a term: the limit is the feature."""
    return G.search(graph(spark, sf_dir)[0], "that")


@query(f"WITH {GRAPH} SELECT id, neighbour, relation, weight, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, relation, neighbour) AS r FROM (SELECT * FROM nb UNION ALL SELECT * FROM rel)) WHERE r <= 10")
def graph_relations_top10(spark, sf_dir):
    return G.strongest(graph(spark, sf_dir)[1], 10, G.related_nearby(compiled(spark, sf_dir), 10))


LINK = "list_distinct(list_transform(regexp_extract_all({}, '\\[\\[([^\\]]+)\\]\\]', 1), lambda x: trim(x)))"
FILES = f"""cmd AS (SELECT src_id, unnest(names) AS name, names, unnest(concepts).explanation AS explanation FROM comp), cfile AS (SELECT src_id, name, '# ' || name || chr(10) || chr(10) || explanation || chr(10) || chr(10) || array_to_string(list_transform(list_filter(names, lambda n: n <> name), lambda n: '[[' || n || ']]'), ', ') || chr(10) AS markdown FROM cmd)"""


@query(f"""WITH {GRAPH}, {MD.removeprefix(COMP + ', ')}, {FILES}, w AS (SELECT 'concept:' || name AS source, 'concept:' || unnest({LINK.format('markdown')}) AS target, 'related_to' AS relation, 0.5::DOUBLE AS weight FROM cfile
 UNION ALL SELECT 'summary:' || ({SLUG}), 'concept:' || unnest({LINK.format('markdown')}), 'contains_concept', 1.0::DOUBLE FROM md JOIN (SELECT src_id, title FROM comp) USING (src_id))
 SELECT source, target, relation, weight, count(*) AS n FROM w WHERE source <> target AND source IN (SELECT id FROM nod) AND target IN (SELECT id FROM nod) GROUP BY 1, 2, 3, 4""")
def graph_wiki_links(spark, sf_dir):
    """Links in the written concept files and summaries as edges, with how many files make each."""
    from corpusloom.functions.text import slug
    from corpusloom.operators import compile as C

    comp = compiled(spark, sf_dir)
    concepts = C.concept_markdown(comp).select(F.concat(F.lit("concept:"), "name").alias("id"), F.col("markdown").alias("text"))
    summaries = C.summary_markdown(comp).join(comp.select("src_id", "title"), "src_id").select(F.concat(F.lit("summary:"), slug(F.col("title"))).alias("id"), F.col("markdown").alias("text"))
    return G.wiki_edges(concepts, summaries, G.nodes(comp)).groupBy("source", "target", "relation", "weight").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH} SELECT 'node' AS kind, '{{\"id\":' || to_json(id) || ',\"label\":' || to_json(label) || ',\"node_type\":' || to_json(node_type) || '}}' AS json FROM nod")
def graph_export(spark, sf_dir):
    """Every node as a line of JSON."""
    nodes, edges = graph(spark, sf_dir)
    return G.exported(nodes, edges).where("kind = 'node'")


@query(f"WITH {GRAPH}, k AS (SELECT id FROM nod WHERE node_type IN ('source', 'concept')) SELECT source, target, relation, weight FROM edg WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)")
def graph_view(spark, sf_dir):
    return G.view(*graph(spark, sf_dir), ["source", "concept"])


COOC = f"{COMP}, dc AS (SELECT DISTINCT src_id, name FROM con), co AS (SELECT x.name AS a, y.name AS b, count(*) AS n FROM dc x JOIN dc y ON x.src_id = y.src_id AND x.name < y.name GROUP BY 1, 2 HAVING count(*) >= 2)"


@query(f"WITH {COOC} SELECT a, b, n, least(0.3::DOUBLE * n, 1.0::DOUBLE) AS weight FROM co")
def concept_cooccurrence(spark, sf_dir):
    rows = G.cooccurrences(compiled(spark, sf_dir))
    return rows.withColumn("weight", F.least(F.lit(0.3) * F.col("n"), F.lit(1.0)))


@query(f"WITH {COMP} SELECT lower(trim(name)) AS key, count(DISTINCT src_id) AS sources, arg_min(explanation, src_id || lpad(place::VARCHAR, 4, '0')) FILTER (explanation <> '') AS explanation FROM con GROUP BY 1")
def concept_clusters(spark, sf_dir):
    return G.clusters(compiled(spark, sf_dir))


@query(f"""WITH {COOC}, tb AS (SELECT a AS name, b AS tag FROM co UNION ALL SELECT b, a FROM co), fo AS (SELECT src_id, tag, 2 AS o FROM dc JOIN tb USING (name) UNION ALL SELECT src_id, name, 1 FROM dc),
be AS (SELECT src_id, tag, min(o) AS o FROM fo GROUP BY src_id, tag), rr AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY o, tag) AS r FROM be) SELECT src_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM rr WHERE r <= 10 GROUP BY src_id""")
def auto_tags(spark, sf_dir):
    return G.tags(compiled(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


@query(f"""WITH {COOC}, clu AS (SELECT lower(trim(name)) AS key, count(DISTINCT src_id) AS sources, arg_min(explanation, src_id || lpad(place::VARCHAR, 4, '0')) FILTER (explanation <> '') AS explanation FROM con GROUP BY 1),
en AS (SELECT lower(trim(a)) AS key, n FROM co UNION ALL SELECT lower(trim(b)), n FROM co), dg AS (SELECT key, count(*) AS degree, round(sum(least(0.3::DOUBLE * n, 1.0::DOUBLE)), 4) AS strength FROM en GROUP BY key),
{PROV.removeprefix(COMP + ', ')}, xp AS (SELECT lower(trim(name)) AS key, round(100.0 * count(*) FILTER (label = 'extracted') / count(*), 2)::DOUBLE AS extracted_pct FROM lab GROUP BY 1)
SELECT key, sources, explanation, coalesce(degree, 0) AS degree, coalesce(strength, 0.0::DOUBLE) AS strength, coalesce(extracted_pct, 0.0::DOUBLE) AS extracted_pct FROM clu LEFT JOIN dg USING (key) LEFT JOIN xp USING (key)""")
def concept_graph(spark, sf_dir):
    """Concept clusters with degree and provenance."""
    comp = compiled(spark, sf_dir)
    return G.concept_graph(comp, Q.traced(comp).select(F.inline("concept_labels")))


@query(f"""WITH {COOC}, o AS (SELECT src_id, names, list_sort(list_distinct(names[1:2])) AS old FROM comp)
SELECT src_id, array_to_string(list_sort(list_distinct(list_concat(old, names))), ',') AS tags, array_to_string(list_sort(list_filter(names, lambda n: NOT list_contains(old, n))), ',') AS added FROM o WHERE len(list_filter(names, lambda n: NOT list_contains(old, n))) > 0""")
def tag_update(spark, sf_dir):
    """Sources that have their first two concepts as tags, brought up to all of them."""
    comp = compiled(spark, sf_dir)
    rows = G.tag_changes(comp.select("src_id", F.slice("concepts.name", 1, 2).alias("tags")), comp.select("src_id", F.col("concepts.name").alias("tags")))
    return rows.select("src_id", *(F.array_join(c, ",").alias(c) for c in ("tags", "added")))
