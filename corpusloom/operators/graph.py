"""A knowledge graph as two tables: nodes (id, label, node_type) and edges (source, target, relation, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import WIKI_LINK, slug
from corpusloom.operators.compile import concept_rows
from corpusloom.operators.manifest import numbered


def nodes(compiled: DataFrame) -> DataFrame:
    """A node for every source, concept and summary."""
    source = compiled.select(F.col("src_id").alias("id"), F.col("title").alias("label"), F.lit("source").alias("node_type"))
    concept = concept_rows(compiled).select("name").distinct().select(F.concat(F.lit("concept:"), "name"), "name", F.lit("concept"))
    name = slug(F.col("title"))
    summary = compiled.select(name.alias("n")).distinct().select(F.concat(F.lit("summary:"), "n"), "n", F.lit("summary"))
    return source.union(concept).union(summary)


def wiki_links(texts: DataFrame) -> DataFrame:
    """texts (id, text) -> id, name of every [[name]], each once."""
    names = F.transform(F.regexp_extract_all("text", F.lit(WIKI_LINK), F.lit(1)), F.trim)
    return texts.select("id", F.explode(F.array_distinct(names)).alias("name"))


def wiki_edges(concept_files: DataFrame, summary_files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that links in files (id, text) make: from concept to concept, and from a summary to the concepts that it names; ends that are no node are dropped, and so are links to oneself."""
    target = F.concat(F.lit("concept:"), "name")
    related = wiki_links(concept_files).select(F.col("id").alias("source"), target.alias("target"), F.lit("related_to").alias("relation"), F.lit(0.5).alias("weight"))
    holds = wiki_links(summary_files).select("id", target, F.lit("contains_concept"), F.lit(1.0))
    return valid(related.union(holds).where("source <> target"), nodes)


def edges(compiled: DataFrame, most_of_type: int = 50) -> DataFrame:
    """source, target, relation, weight: compiled_to, contains_concept, and same_type between the first `most_of_type` sources of a type.

    Sources that share a concept are all linked to each other; these links are given as classes
    (`mentions`, `mention_classes`, `related_counts`), as their pairs grow with the square of a class.
    """
    to = compiled.select(F.col("src_id").alias("source"), F.concat(F.lit("summary:"), slug(F.col("title"))).alias("target"), F.lit("compiled_to").alias("relation"), F.lit(1.0).alias("weight"))
    contains = mentions(compiled).select(F.col("src_id").alias("source"), F.concat(F.lit("concept:"), "name").alias("target"), F.lit("contains_concept"), F.lit(1.0))
    # The first of a type are few, and picked before the shuffle; so are their pairs.
    place = F.row_number().over(Window.partitionBy("type").orderBy("src_id"))
    first = compiled.select("type", "src_id").distinct().withColumn("r", place).where(F.col("r") <= most_of_type)
    a, b = first.select("type", F.col("src_id").alias("source"), "r"), first.select("type", F.col("src_id").alias("target"), F.col("r").alias("q"))
    same = a.join(b, "type").where("r < q").select("source", "target", F.lit("same_type"), F.lit(0.1))
    return to.union(contains).union(same)


def mentions(compiled: DataFrame) -> DataFrame:
    """src_id, name: which source names which concept, each once. The members of the co-mention classes."""
    return concept_rows(compiled).select("src_id", "name").distinct()


def mention_classes(compiled: DataFrame) -> DataFrame:
    """name, sources, links: the number of sources that share a concept, and of the related_to links between them."""
    n = F.col("sources")
    return mentions(compiled).groupBy("name").agg(F.count("*").alias("sources")).where("sources > 1").withColumn("links", (n * (n - 1) / 2).cast("long"))


def related_counts(compiled: DataFrame) -> DataFrame:
    """src_id, links: how many related_to links (weight 0.3, one for each concept and other source that shares it) a source has."""
    return mentions(compiled).join(mention_classes(compiled), "name").groupBy("src_id").agg(F.sum(F.col("sources") - 1).alias("links"))


def related_pairs(compiled: DataFrame, sources: DataFrame) -> DataFrame:
    """source, target, shared: all related_to links of the asked sources (src_id), with the number of concepts shared. For a set of questions, not for whole corpora."""
    rows = mentions(compiled)
    asked = rows.join(sources.select("src_id"), "src_id", "left_semi").select(F.col("src_id").alias("source"), "name")
    met = asked.join(rows.withColumnRenamed("src_id", "target"), "name").where("source <> target")
    return met.groupBy("source", "target").agg(F.count("*").alias("shared"))


def related_nearby(compiled: DataFrame, k: int = 10) -> DataFrame:
    """id, neighbour, relation, weight: of each source's related_to links, both ways, those among which its first k by neighbour are.

    In the order of ids a source's first k later companions in a class are the k after it, and its
    first earlier ones the k at the class's beginning; so a class of n gives at most 2 * k * n rows.
    """
    rows = numbered(mentions(compiled), ["name"], ["src_id"], "n")
    members = rows.select("name", F.col("src_id").alias("neighbour"), F.col("n").alias("at"))
    steps = F.sequence(F.lit(1), F.lit(k)).cast("array<long>")
    later = rows.withColumn("at", F.explode(F.transform(steps, lambda i: F.col("n") + i))).withColumn("relation", F.lit("related_to"))
    early = rows.withColumn("at", F.explode(F.filter(steps, lambda i: i < F.col("n")))).withColumn("relation", F.lit("reverse_related_to"))
    return later.unionByName(early).join(members, ["name", "at"]).select(F.col("src_id").alias("id"), "neighbour", "relation", F.lit(0.3).alias("weight")).distinct()


def valid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, edges["target"] == ids["id"], "left_semi")


def degrees(edges: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """id, degree over edges, and over related_to links given by their number (src_id, links)."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).cast("long").alias("n")).union(edges.select("target", F.lit(1).cast("long")))
    if related is not None:
        ends = ends.union(related.select("src_id", "links"))
    return ends.groupBy("id").agg(F.sum("n").alias("degree"))


def stats(nodes: DataFrame, edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """kind, name, n: nodes by type, edges by relation, related_to links from their classes."""
    rows = nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("name")).agg(F.count("*").alias("n")).union(edges.groupBy(F.lit("edge"), F.col("relation")).agg(F.count("*")))
    return rows if classes is None else rows.union(classes.agg(F.sum("links").alias("n")).where("n > 0").select(F.lit("edge"), F.lit("related_to"), "n"))


def search(nodes: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """id, label, score: an equal label 2, a part of the label or id 1, a part of a value in `metadata` (a map, if nodes have it) 0."""
    low, t = F.lower("label"), term.lower()
    points = F.when(low == t, 2).when(F.contains(low, F.lit(t)) | F.contains(F.lower("id"), F.lit(t)), 1)
    if "metadata" in nodes.columns:
        points = points.when(F.exists(F.map_values("metadata"), lambda v: F.contains(F.lower(v), F.lit(t))), 0)
    return nodes.withColumn("score", points).where("score IS NOT NULL").select("id", "label", "score").orderBy(F.desc("score"), "id").limit(limit)


def exported(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, json: a line for every node and edge."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "label", "node_type")).alias("json")).union(edges.select(F.lit("edge"), F.to_json(F.struct("source", "target", "relation", "weight"))))


def neighbours(edges: DataFrame) -> DataFrame:
    """id, neighbour, relation, weight, both ways; the way back has its relation prefixed."""
    there = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbour"), "relation", "weight")
    back = edges.select("target", "source", F.concat(F.lit("reverse_"), "relation"), "weight")
    return there.union(back)


def strongest(edges: DataFrame, k: int = 10, more: DataFrame | None = None) -> DataFrame:
    """The k strongest relations of each node, over edges and over further neighbours (id, neighbour, relation, weight)."""
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "relation", "neighbour")
    rows = neighbours(edges) if more is None else neighbours(edges).union(more)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cooccurrences(compiled: DataFrame, least: int = 2) -> DataFrame:
    """a, b, n: concepts that occur together in at least `least` sources. A source has a handful of concepts, so its pairs are few."""
    names = F.sort_array(F.array_distinct(F.filter(F.flatten(F.collect_list("concepts.name")), lambda x: x.isNotNull())))
    rows = compiled.groupBy("src_id").agg(names.alias("names"))
    each = F.transform("names", lambda x, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = rows.select(F.inline(F.flatten(each)))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def clusters(compiled: DataFrame) -> DataFrame:
    """key, sources, explanation: concepts by folded name, with the first explanation there is."""
    rows = concept_rows(compiled).withColumn("key", F.lower(F.trim("name"))).where("key <> ''")
    first = F.min_by("explanation", F.when(F.col("explanation") != "", F.struct("src_id", "place")))
    return rows.groupBy("key").agg(F.count_distinct("src_id").alias("sources"), first.alias("explanation"))


def tags(compiled: DataFrame, most: int = 10, own_most: int = 5) -> DataFrame:
    """src_id, tags: the first five concepts, and concepts that go with them elsewhere.

    A concept's companions are cut to the first `most` + `own_most` before sources meet them: no more
    of one concept can be among a source's tags, whatever its other concepts are.
    """
    own = concept_rows(compiled).where(F.col("place") < own_most).select("src_id", "name").distinct()
    turned = F.array(F.struct(F.col("a").alias("name"), F.col("b").alias("tag")), F.struct(F.col("b").alias("name"), F.col("a").alias("tag")))
    both = cooccurrences(compiled).select(F.inline(turned))
    few = both.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("tag"))).where(F.col("r") <= most + own_most)
    few = few.groupBy("name").agg(F.collect_list("tag").alias("tags"))  # an array a concept: a source's rows are its own concepts
    rows = own.join(few, "name", "left").groupBy("src_id").agg(F.sort_array(F.collect_list("name")).alias("own"), F.flatten(F.collect_list("tags")).alias("others"))
    others = F.sort_array(F.array_except("others", "own"))
    return rows.select("src_id", F.sort_array(F.slice(F.concat("own", others), 1, most)).alias("tags"))


def tag_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """src_id, tags, added of sources whose tags (src_id, tags) grow: old and new ones in order, and the new ones alone."""
    rows = before.join(after.withColumnRenamed("tags", "found"), "src_id")
    rows = rows.select("src_id", F.array_sort(F.array_union("tags", "found")).alias("tags"), F.array_sort(F.array_except("found", "tags")).alias("added"))
    return rows.where(F.size("added") > 0)


def concept_graph(compiled: DataFrame, labels: DataFrame) -> DataFrame:
    """key, sources, explanation, degree, strength, extracted_pct: concept clusters with their co-occurrence degree, the sum of its weights, and the share of mentions that labels (name, label) call extracted."""
    pairs = cooccurrences(compiled)
    ends = pairs.select(F.col("a").alias("name"), "n").union(pairs.select("b", "n")).withColumn("key", F.lower(F.trim("name")))
    degree = ends.groupBy("key").agg(F.count("*").alias("degree"), F.round(F.sum(F.least(F.lit(0.3) * F.col("n"), F.lit(1.0))), 4).alias("strength"))
    share = labels.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.round(100.0 * F.count_if(F.expr("label = 'extracted'")) / F.count("*"), 2).alias("extracted_pct"))
    rows = clusters(compiled).join(degree, "key", "left").join(share, "key", "left")
    return rows.select("key", "sources", "explanation", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce("extracted_pct", F.lit(0.0)).alias("extracted_pct"))


def view(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges of the view that keeps nodes of these types."""
    return valid(edges, nodes.where(F.col("node_type").isin(kinds)))
