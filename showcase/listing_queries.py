"""Listing, search, lookup, tree and link queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from entityframe import EntitySchema, EntityStore, Field, PropertyFilter, entities_from, tune
from entityframe.functions import paths
from entityframe.functions.props import Bag
from entityframe.operators import links, listing, ordinal, tree, writes
from entityframe.operators.listing import Listing, PathFilter
from entityframe.sources import colocated
from showcase import fixtures as X
from showcase.registry import query


# --- listing ------------------------------------------------------------------------------------


@query(
    """
    SELECT 'order:' || o_orderkey AS id, o_orderpriority, o_totalprice FROM orders
    ORDER BY CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 1 ELSE 0 END,
             lower(CASE WHEN o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') THEN o_orderpriority ELSE '' END) DESC,
             o_orderdate DESC, id LIMIT 30 OFFSET 20
    """
)
def list_sorted_page(spark, sf):
    """Sorted by a property: blanks last, newest first among equals."""
    tune(spark)
    options = Listing(organization=X.ORG, entity_type="Order", sort="property", sort_property="note", direction="desc")
    page = listing.list_entities(X.orders(spark, sf), options, 30, 20)
    return page.select("id", F.col("@o_orderpriority").alias("o_orderpriority"), F.col("@o_totalprice").alias("o_totalprice"))


@query(
    """
    SELECT 'part:' || p_partkey AS id, p_name, p_brand FROM part
    WHERE p_name ILIKE '%RED%' AND p_brand ILIKE '%brand_1%'
    """
)
def list_property_ilike(spark, sf):
    """Case-insensitive contains, wildcards included, AND-ed with a blank (key exists) test."""
    wanted = (PropertyFilter("p_name", " RED "), PropertyFilter("p_brand", "brand_1"), PropertyFilter("p_size", ""))
    found = listing.matching(X.parts(spark, sf), Listing(filters=wanted))
    return found.select("id", F.col("@p_name").alias("p_name"), F.col("@p_brand").alias("p_brand"))


@query(
    """
    SELECT 'customer:' || c_custkey AS id, 'Customer' AS entity_type FROM customer WHERE c_mktsegment ILIKE '%house%'
    UNION ALL SELECT 'part:' || p_partkey, 'Part' FROM part WHERE p_name ILIKE '%house%' OR p_brand ILIKE '%house%' OR p_type ILIKE '%house%'
    UNION ALL SELECT 'doc:' || doc_id, 'Document' FROM documents
      WHERE text ILIKE '%house%' OR lang ILIKE '%house%' OR source ILIKE '%house%'
    """
)
def list_text_search(spark, sf):
    """One term over type, path and every property of several types."""
    every = X.store(spark, sf, "Customer", "Part", "Document").all()
    return listing.matching(every, Listing(organization=X.ORG, text="house")).select("id", "entity_type")


@query("SELECT COUNT(*) AS total FROM orders WHERE o_orderpriority ILIKE '%high%'")
def list_total(spark, sf):
    found = listing.matching(X.orders(spark, sf), Listing(entity_type="Order", filters=(PropertyFilter("o_orderpriority", "high"),)))
    return listing.total(found)


@query("SELECT COUNT(*) AS total, true AS has_previous, COUNT(*) > 45 AS has_next FROM orders WHERE o_orderstatus ILIKE '%f%'")
def list_page_info(spark, sf):
    found = listing.matching(X.orders(spark, sf), Listing(filters=(PropertyFilter("o_orderstatus", "f"),)))
    return listing.page_info(found, 25, 20)


TREE = """
    WITH tree AS (
      SELECT 'region:' || r_regionkey AS id, 'Region' AS entity_type, 'r' || r_regionkey AS path FROM region
      UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', 'r' || n_regionkey || '.n' || n_nationkey FROM nation
      UNION ALL SELECT 'customer:' || c_custkey, 'Customer', 'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey
        FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', 'r' || n_regionkey || '.n' || n_nationkey || '.s' || s_suppkey
        FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


@query(TREE + "SELECT id, entity_type, path FROM tree WHERE (path = 'r1.n6' OR path LIKE 'r1.n6.%') ")
def list_path_filter(spark, sf):
    every = X.tree_store(spark, sf).all()
    found = listing.matching(every, Listing(organization=X.ORG, path=PathFilter(descendants_of="r1.n6")))
    return found.select("id", "entity_type", "path")


@query("SELECT 'nation:' || n_nationkey AS id, n_name FROM nation")
def list_by_type(spark, sf):
    every = X.store(spark, sf, "Region", "Nation").all()
    found = listing.list_by_type(every, "Nation")
    return found.select("id", Bag.of(found).text("n_name").alias("n_name"))


# --- search -------------------------------------------------------------------------------------


@query(
    """
    SELECT event_id, event_type FROM events
    WHERE event_type = 'click' AND CAST(props->>'k' AS INTEGER) = 9
    """
)
def search_containment(spark, sf):
    """Nested JSON containment on schemaless bags: object, list element and plain value."""
    df = X.events(spark, sf)
    found = listing.search_containment(df, {"type": "click", "meta": {"k": 9}, "tags": ["click"]})
    return found.select(F.regexp_replace("id", "event:", "").cast("bigint").alias("event_id"), Bag.of(found).text("type").alias("event_type"))


@query(
    """
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 11 AND l_returnflag = 'N' AND l_linenumber = 3
    """
)
def search_containment_typed(spark, sf):
    """The same on typed bags: the list part becomes an exists, the rest plain comparisons."""
    found = listing.search_containment(
        X.lineitems(spark, sf), {"refs": ["part:11"], "l_returnflag": "N", "l_linenumber": 3}
    )
    return found.select(F.col("@l_orderkey").alias("l_orderkey"), F.col("@l_linenumber").alias("l_linenumber"))


@query("SELECT event_id, user_id FROM events WHERE user_id BETWEEN 10 AND 40 AND event_type <> 'error'")
def search_range(spark, sf):
    """Errors hold the user as text, which is no number, so they are out."""
    found = listing.search_range(X.events(spark, sf), "user", 10, 40)
    return found.select(
        F.regexp_replace("id", "event:", "").cast("bigint").alias("event_id"), Bag.of(found).typed("user", "bigint").alias("user_id")
    )


@query("SELECT 'event:' || event_id AS id FROM events WHERE event_type = 'purchase'")
def search_exists(spark, sf):
    """A key that holds JSON null still exists."""
    return listing.search_exists(X.events(spark, sf), "refund").select("id")


@query("SELECT 'doc:' || doc_id AS id, n_chars FROM documents WHERE contains(lower(text), 'heed')")
def search_contains(spark, sf):
    found = listing.search_contains(X.documents(spark, sf), "text", "HeeD")
    return found.select("id", F.col("@n_chars").alias("n_chars"))


# --- lookups and counts -------------------------------------------------------------------------


@query(
    """
    SELECT o_orderkey AS pos, 'customer:' || (o_custkey * 2) AS requested_id, c_name
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2
    """
)
def lookup_ids_ordered(spark, sf):
    """A batch of ids in request order; an id nobody has keeps an empty row."""
    tune(spark)
    wanted = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), X.ref("customer", F.col("o_custkey") * 2).alias("id"))
    found = listing.by_ids(X.customers(spark, sf), wanted)
    return found.select("pos", "requested_id", F.col("@c_name").alias("c_name"))


@query(
    """
    SELECT o_orderkey AS pos, 'customer:' || (o_custkey * 2) AS requested_id, c_name
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2
    """
)
def lookup_ids_colocated(spark, sf):
    """The same requests against a table bucketed by id."""
    tune(spark)
    wanted = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), X.ref("customer", F.col("o_custkey") * 2).alias("id"))
    table = colocated.save_by_id(X.customers(spark, sf), buckets=4)
    return colocated.lookup(table, wanted).select("pos", "requested_id", F.col("@c_name").alias("c_name"))


@query(
    """
    (SELECT 10 AS page, 'order:' || o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 300 OFFSET 3000)
    UNION ALL (SELECT 11, 'order:' || o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 300 OFFSET 3300)
    """
)
def list_deep_pages(spark, sf):
    """Two deep pages from one index, each of which reads the ranges it lies in."""
    tune(spark)
    orders = X.table(spark, sf, "orders").select(X.ref("order", "o_orderkey").alias("id"), "o_totalprice", "o_orderkey")
    index = ordinal.PageIndex(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    pages = [index.page(300, 300 * n).select(F.lit(n).alias("page"), "id") for n in (10, 11)]
    return pages[0].unionByName(pages[1])


@query(
    """
    SELECT 'customer:' || c_custkey AS id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey * 2 FROM orders)
    """
)
def lookup_references(spark, sf):
    """Padded and repeated reference texts."""
    tune(spark)
    key = F.concat(F.lit("  Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"), F.lit(" "))
    wanted = X.table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "P", "  ").otherwise(key).alias("reference"))
    more = X.table(spark, sf, "orders").select(key.alias("reference"))
    found = listing.by_references(X.customers(spark, sf), X.SCHEMAS["Customer"], wanted.unionByName(more))
    return found.select("id", F.col("@c_name").alias("c_name"))


@query(
    """
    SELECT 'org-1' AS organization_id, 'Customer' AS entity_type, COUNT(*) AS entities FROM customer
    UNION ALL SELECT 'org-1', 'Order', COUNT(*) FROM orders
    UNION ALL SELECT 'org-1', 'LineItem', COUNT(*) FROM lineitem
    UNION ALL SELECT 'org-1', 'Event', COUNT(*) FROM events
    """
)
def count_by_org_type(spark, sf):
    return listing.count_by_type(X.store(spark, sf, "Customer", "Order", "LineItem", "Event").envelopes())


@query(
    """
    SELECT 'org-1' AS organization_id,
           (SELECT COUNT(*) FROM customer) + (SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM lineitem) AS entities
    """
)
def count_by_org(spark, sf):
    return listing.count_by_organization(X.store(spark, sf, "Customer", "Order", "LineItem").envelopes())


@query(
    """
    SELECT 'part:' || p_partkey AS id, p_name AS value FROM part
    UNION ALL SELECT 'order:' || o_orderkey, 'order:' || o_orderkey FROM orders
    UNION ALL SELECT 'customer:' || c_custkey,
      CASE WHEN c_mktsegment = 'FURNITURE' THEN 'customer:' || c_custkey ELSE c_name END FROM customer
    """
)
def reference_value(spark, sf):
    """Trimmed canonical reference, or the id where there is none or it is blank."""
    tune(spark)
    parts = X.parts(spark, sf).withColumn("@p_name", F.concat(F.lit(" "), F.col("@p_name"), F.lit("  ")))
    orders = X.orders(spark, sf)
    customers = X.customers(spark, sf)
    blank = F.when(F.col("@c_mktsegment") == "FURNITURE", F.lit("  ")).otherwise(F.col("@c_name"))
    customers = customers.withColumn("@c_name", blank)
    shown = [
        df.select("id", listing.reference_value(df, X.SCHEMAS[t]).alias("value"))
        for t, df in (("Part", parts), ("Order", orders), ("Customer", customers))
    ]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query(
    """
    SELECT p_name AS reference, COUNT(*) AS uses, MIN('part:' || p_partkey) AS first_id FROM part
    GROUP BY p_name HAVING COUNT(*) > 1
    """
)
def reference_duplicates(spark, sf):
    found = listing.reference_duplicates(X.parts(spark, sf), X.SCHEMAS["Part"])
    return found.select("reference", "uses", "first_id")


@query(
    """
    SELECT 'new:' || s_suppkey AS id FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation)
    """
)
def reference_conflicts(spark, sf):
    """New entities that claim a reference an existing one already uses."""
    tune(spark)
    name = F.concat(F.lit(" NATION_"), F.col("s_nationkey"))
    new = X.entities_from(X.table(spark, sf, "supplier"), "Nation", X.ref("new", "s_suppkey"), [name.alias("n_name")], organization=X.ORG)
    return listing.reference_conflicts(new, X.nations(spark, sf), X.SCHEMAS["Nation"]).select("id")


# --- tree ---------------------------------------------------------------------------------------


@query(TREE + "SELECT a.id AS anchor_id, t.id, t.entity_type, length(t.path) - length(replace(t.path, '.', '')) + 1 AS depth FROM tree a JOIN tree t ON starts_with(a.path, t.path || '.') WHERE a.entity_type IN ('Customer', 'Supplier')")
def tree_ancestors(spark, sf):
    """Ancestors of every customer and supplier: label prefixes joined on equality."""
    s = X.tree_store(spark, sf)
    found = tree.ancestors(s.envelopes(), s.envelopes(["Customer", "Supplier"]))
    return found.select("anchor_id", "id", "entity_type", F.col("depth").cast("bigint").alias("depth"))


@query(TREE + "SELECT a.id AS anchor_id, t.id FROM tree a JOIN tree t ON t.path = a.path OR starts_with(t.path, a.path || '.') WHERE a.entity_type = 'Region'")
def tree_descendants(spark, sf):
    s = X.tree_store(spark, sf)
    return tree.descendants(s.envelopes(), s.envelopes(["Region"])).select("anchor_id", "id")


@query(
    TREE
    + """
    SELECT a.path, COUNT(DISTINCT t.path) AS n_below FROM tree a LEFT JOIN tree t ON starts_with(t.path, a.path || '.')
    WHERE a.path IS NOT NULL GROUP BY a.path
    """
)
def tree_subtree_sizes(spark, sf):
    """How many paths lie below each, from the pre-order numbers alone."""
    return tree.TreeIndex(X.tree_store(spark, sf).envelopes()).sizes().select("path", "n_below")


@query(
    TREE
    + """
    , anchors AS (SELECT * FROM tree WHERE entity_type IN ('Nation', 'Supplier'))
    SELECT a.id AS anchor_id, t.id, 'current' AS relation FROM anchors a JOIN tree t ON t.path = a.path
    UNION ALL SELECT a.id, t.id, 'ancestor' FROM anchors a JOIN tree t ON starts_with(a.path, t.path || '.')
    UNION ALL SELECT a.id, t.id, 'child' FROM anchors a JOIN tree t ON regexp_extract(t.path, '^(.*)\\.[^.]*$', 1) = a.path
    UNION ALL SELECT a.id, t.id, 'sibling' FROM anchors a JOIN tree t
      ON regexp_extract(t.path, '^(.*)\\.[^.]*$', 1) = regexp_extract(a.path, '^(.*)\\.[^.]*$', 1) AND t.path <> a.path
    """
)
def tree_hierarchies(spark, sf):
    """The whole hierarchy of every nation and supplier at once."""
    s = X.tree_store(spark, sf)
    return tree.hierarchies(s.envelopes(), s.envelopes(["Nation", "Supplier"])).select("anchor_id", "id", "relation")


@query(TREE + "SELECT a.id AS anchor_id, t.id FROM tree a JOIN tree t ON regexp_extract(t.path, '^(.*)\\.[^.]*$', 1) = a.path WHERE a.entity_type = 'Nation'")
def tree_children(spark, sf):
    s = X.tree_store(spark, sf)
    return tree.children(s.envelopes(), s.envelopes(["Nation"])).select("anchor_id", "id")


@query(TREE + "SELECT id, path FROM tree WHERE regexp_extract(path, '^(.*)\\.[^.]*$', 1) = 'r2.n2' AND path <> 'r2.n2.c0'")
def tree_siblings(spark, sf):
    return tree.siblings_of(X.tree_store(spark, sf).envelopes(), "r2.n2.c0").select("id", "path")


@query(
    TREE
    + """
    SELECT id, path, CASE WHEN path = 'r1.n1' THEN 'current' WHEN path = 'r1' THEN 'ancestor'
      WHEN starts_with(path, 'r1.n1.') THEN 'child' ELSE 'sibling' END AS relation
    FROM tree WHERE path = 'r1' OR starts_with(path, 'r1.n1.') OR (starts_with(path, 'r1.') AND entity_type = 'Nation')
    """
)
def tree_hierarchy(spark, sf):
    return tree.hierarchy_of(X.tree_store(spark, sf).envelopes(), "r1.n1").select("id", "path", "relation")


@query(
    TREE
    + """
    SELECT id, length(path) - length(replace(path, '.', '')) + 1 AS depth, regexp_extract(path, '^(.*)\\.[^.]*$', 1) AS parent,
           split_part(path, '.', 1) AS root, starts_with(path, 'r1.') AS below_r1,
           regexp_extract(path, '^(.*)\\.[^.]*$', 1) = 'r1' AS child_of_r1, false AS numeric_ok, true AS labels_ok
    FROM tree
    """
)
def tree_path_parts(spark, sf):
    at = F.col("path")
    return X.tree_store(spark, sf).envelopes().select(
        "id",
        paths.depth(at).cast("bigint").alias("depth"),
        paths.parent(at).alias("parent"),
        F.get(paths.components(at), F.lit(0)).alias("root"),
        paths.is_ancestor(F.lit("r1"), at).alias("below_r1"),
        paths.is_child(at, F.lit("r1")).alias("child_of_r1"),
        paths.is_valid(at).alias("numeric_ok"),
        paths.is_valid(at, numeric=False).alias("labels_ok"),
    )


@query(
    """
    SELECT l_partkey || '.' || l_linenumber || '.' || l_orderkey AS path FROM lineitem
    ORDER BY l_partkey, l_linenumber, l_orderkey LIMIT 300 OFFSET 1200
    """
)
def tree_path_order(spark, sf):
    """Paths order label by label as numbers."""
    tune(spark)
    df = X.table(spark, sf, "lineitem").select(F.concat_ws(".", "l_partkey", "l_linenumber", "l_orderkey").alias("path"))
    return tree.page_by_path(df, 300, 1200)


@query(
    """
    SELECT event_id, 'u' || user_id || '.' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS path FROM events
    """
)
def tree_generate_paths(spark, sf):
    """Children numbered under their parent; the numbering is cut into bounded slices of the order."""
    tune(spark)
    df = X.table(spark, sf, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id")).alias("up"))
    chunk = F.floor(F.col("event_id") / ordinal.ROWS_PER_CHUNK)
    return tree.generate_paths(df, "up", ["event_id"], "path", chunk).select("event_id", "path")


@query(
    """
    SELECT CAST(l_orderkey AS VARCHAR) AS parent, CAST(MAX(l_linenumber) + 1 AS BIGINT) AS next_index,
           l_orderkey || '.' || (MAX(l_linenumber) + 1) AS next_path
    FROM lineitem GROUP BY l_orderkey
    """
)
def tree_next_sibling(spark, sf):
    tune(spark)
    df = X.table(spark, sf, "lineitem").select(
        F.lit(X.ORG).alias("organization_id"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("path")
    )
    return tree.next_paths(df).select("parent", "next_index", "next_path")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '1' ELSE user_id || '.' || (event_id + 1) END AS next_path FROM events")
def tree_next_label(spark, sf):
    """The sibling path after a given one, row by row."""
    path = F.when(F.col("event_type") == "error", "").otherwise(F.concat_ws(".", "user_id", "event_id"))
    return X.table(spark, sf, "events").select("event_id", paths.next_sibling(path).alias("next_path"))


# --- links --------------------------------------------------------------------------------------


CLOSURE_TYPES = """
    WITH RECURSIVE who AS (SELECT c_custkey AS k, c_nationkey = 3 AS lead, (c_custkey * c_custkey + 7) % (SELECT COUNT(*) + 1 FROM customer) AS next FROM customer),
    walk AS (
      SELECT k, [k] AS seen FROM who WHERE lead
      UNION ALL SELECT w.next, list_append(walk.seen, w.next) FROM walk JOIN who w ON w.k = walk.k
      WHERE w.next IN (SELECT k FROM who) AND NOT list_contains(walk.seen, w.next)),
    far AS (SELECT k, MIN(len(seen)) AS hop FROM walk GROUP BY k)
"""


@query(
    CLOSURE_TYPES
    + """
    SELECT 'person:' || w.k AS parent_id, 'person:' || w.next AS child_id, CAST(hop AS INTEGER) AS hop
    FROM far JOIN who w ON w.k = far.k WHERE w.next IN (SELECT k FROM who)
    """
)
def links_closure(spark, sf):
    """Everything the leads reach over chains that run into cycles, with the shortest distance."""
    df = X.table(spark, sf, "customer")
    n = df.count() + 1
    rows = df.select(X.ref("person", "c_custkey").alias("id"), X.ref("person", (F.col("c_custkey") * F.col("c_custkey") + 7) % n).alias("next"), "c_nationkey")
    s = EntityStore(organization=X.ORG)
    for name, own in (("Lead", F.col("c_nationkey") == 3), ("Follower", F.col("c_nationkey") != 3)):
        fields = EntitySchema(name, (Field("next", "ENTITY_REFERENCE"),))
        s.add(name, entities_from(rows.filter(own), name, "id", ["next"], organization=X.ORG), fields)
    return links.closure(s, ["Lead"], id_norm=X.text_id).select("parent_id", "child_id", "hop")


@query(
    """
    SELECT 'order:' || o_orderkey AS parent_id, 'customer:' || o_custkey AS child_id, 1 AS hop FROM orders
    UNION SELECT 'order:' || o_orderkey, 'customer:' || (o_custkey * 2), 1 FROM orders
      WHERE o_custkey * 2 IN (SELECT c_custkey FROM customer)
    UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 2 FROM customer
      WHERE c_custkey IN (SELECT o_custkey FROM orders) OR c_custkey IN (SELECT o_custkey * 2 FROM orders)
    """
)
def links_enriched(spark, sf):
    """Orders' links, and the links of what they reach; a customer names its nation twice, by id
    and by reference, and gets it once."""
    s = X.store(spark, sf, "Order", "Customer", "Nation")
    return links.enrich(s, ["Order"], hops=2, id_norm=X.text_id).select("parent_id", "child_id", "hop")


@query(
    """
    SELECT 'order:' || o_orderkey AS parent_id, 'id' AS "by", 'Customer' AS target_type, 'customer:' || (o_custkey * 2) AS key
    FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'customer:' || c_custkey, 'reference', 'Nation', 'ATLANTIS' FROM customer WHERE c_mktsegment = 'MACHINERY'
    """
)
def links_dangling(spark, sf):
    s = X.store(spark, sf, "Order", "Customer", "Nation")
    table = links.all_links(s, ["Order", "Customer"], X.text_id)
    return links.dangling(table, s).select("parent_id", "by", "target_type", "key")


@query(
    """
    SELECT 'order:' || o_orderkey AS id, CASE WHEN o_custkey * 2 = o_custkey THEN 'customer:' || o_custkey
      ELSE 'customer:' || o_custkey || '|customer:' || (o_custkey * 2) END AS linked_ids, CAST(NULL AS VARCHAR) AS link_error
    FROM orders
    """
)
def link_merge(spark, sf):
    """Requested ids, padded and repeated, join the undeclared link list."""
    tune(spark)
    df = X.orders(spark, sf)
    asked = df.withColumn("__ask", F.array(F.concat(F.lit(" "), F.col("@o_custkey")), F.col("@partner"), F.lit(" "), F.col("@o_custkey")))
    merged = links.merge_links(asked, X.SCHEMAS["Order"], F.col("__ask"), X.text_id)
    return merged.select("id", F.array_join("properties.linked_ids", "|").alias("linked_ids"), "link_error")


@query(
    """
    SELECT 'new:' || c_custkey AS id,
           CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation) THEN 'an entity of type Nation already uses reference "NATION_' || c_nationkey || '"'
             ELSE '' END || CASE WHEN c_mktsegment = 'BUILDING' THEN '; region: required field ''region'' is missing' ELSE '' END AS errors
    FROM customer WHERE c_mktsegment <> 'FURNITURE'
    UNION ALL SELECT 'new:' || c_custkey, CASE WHEN 'new:' || c_custkey = (SELECT MIN('new:' || c_custkey) FROM customer WHERE c_mktsegment = 'FURNITURE')
      THEN '' ELSE 'an entity of type Nation already uses reference "UTOPIA"' END FROM customer WHERE c_mktsegment = 'FURNITURE'
    """
)
def insert_checks(spark, sf):
    """A batch of new entities: references taken by stored ones or repeated in the batch, and
    missing fields."""
    tune(spark)
    name = F.when(F.col("c_mktsegment") == "FURNITURE", " UTOPIA ").otherwise(F.concat(F.lit("NATION_"), F.col("c_nationkey")))
    region = F.when(F.col("c_mktsegment") != "BUILDING", F.lit("region:1"))
    props = [F.col("c_custkey").alias("n_nationkey"), name.alias("n_name"), region.alias("region")]
    new = X.entities_from(X.table(spark, sf, "customer"), "Nation", X.ref("new", "c_custkey"), props, organization=X.ORG)
    checked = writes.check_inserts(new, X.SCHEMAS["Nation"], X.nations(spark, sf), id_norm=X.text_id)
    return checked.select("id", F.array_join("errors", "; ").alias("errors"))
