"""The registered queries over the given tables, each next to its SQL where it has one.

The tables stand in for catalogue data: events for files and metrics, documents and
pages for resources, customers and orders for records. All of them are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import text, urls, values
from shelfmark.operators import counts, ingest, load_order, manifests, pattern_tables, records, retention, selection
from shelfmark.plans import merged_store, restore, seeding
from shelfmark.session import fresh_dir
from shelfmark.sources import arrays, listings, prepared, snapshots
from shelfmark.sources import records as record_files
from shelfmark.streaming import monitoring, overdue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The present moment of every query with an age in it.
NOW = datetime(2024, 1, 31)
KINDS = ("layers", "maps", "documents")


def registered(sql: str | None = None):
    """Register a query under its function name, with the SQL that gives the same rows."""

    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# == counts and browsing ===========================================================

def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as layers and documents as documents; there are no maps."""
    layers = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.lit("layers").alias("kind"), F.col("url").alias("name")
    )
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit("documents").alias("kind"), F.col("source").alias("name")
    )
    return layers.unionByName(documents)


@registered("""
    WITH kinds(kind) AS (VALUES ('layers'), ('maps'), ('documents')),
         resources AS (SELECT 'layers' AS kind FROM pages
                       UNION ALL SELECT 'documents' FROM documents)
    SELECT k.kind, count(r.kind) AS n
    FROM kinds k LEFT JOIN resources r ON r.kind = k.kind GROUP BY k.kind
""")
def resource_counts(spark, sf_dir):
    return counts.resource_counts(_resources(spark, sf_dir), KINDS)


@registered("""
    SELECT (SELECT count(*) FROM pages) AS layers, CAST(0 AS BIGINT) AS maps,
           (SELECT count(*) FROM documents) AS documents
""")
def resource_counts_wide(spark, sf_dir):
    return counts.counts_wide(_resources(spark, sf_dir), KINDS)


@registered("SELECT page_id AS id, 'layers' AS kind, url AS name FROM pages")
def resource_browse(spark, sf_dir):
    return selection.browse(_resources(spark, sf_dir), "layers")


# == filters =======================================================================

@registered("""
    SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate FROM orders
    WHERE (o_orderpriority GLOB '[1-4]-*' OR o_orderpriority GLOB '5*')
      AND NOT (o_orderpriority GLOB '*SPEC*' OR o_orderpriority GLOB '?-LOW')
      AND o_orderdate > TIMESTAMP '1997-03-05 12:00:00' AND o_orderstatus = 'F'
""")
def layer_select(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    layers = orders.select(
        "o_orderkey",
        "o_orderpriority",
        "o_orderstatus",
        "o_orderdate",
        F.when(F.col("o_orderstatus") == "F", "vector").otherwise("raster").alias("kind"),
    )
    return selection.select_layers(
        layers,
        include="[1-4]-*, 5*",
        exclude="*SPEC*,?-LOW",
        data_time="> 1997-03-05T12:00",
        raster=False,
        name="o_orderpriority",
        time="o_orderdate",
    ).drop("kind")


@registered("""
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'vector' WHEN 'O' THEN
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'time' ELSE 'raster' END END AS kind
    FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT')
""")
def layer_select_kinds(spark, sf_dir):
    """Switching one kind off leaves kinds without a switch, and layers without a kind."""
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "vector").when(
        status == "O", F.when(F.col("o_orderpriority") == "1-URGENT", "time").otherwise("raster")
    )
    layers = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"))
    return selection.select_layers(layers, raster=False)


@registered("""
    SELECT doc_id, source FROM documents
    WHERE (source GLOB 'src1*' OR source IN ('src2', 'src3')) AND NOT source IN ('src11', 'src13')
""")
def name_select(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    name = F.col("source")
    return documents.where(
        selection.included(name, ["src1*", "src2", "src3"])
        & selection.not_excluded(name, ["src11", "src13"])
    ).select("doc_id", "source")


@registered("""
    SELECT doc_id, concat(source, '.', lang) AS model FROM documents
    WHERE source IN ('src1', 'src4', 'src9')
""")
def app_select(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    models = documents.select("doc_id", F.concat_ws(".", "source", "lang").alias("model"))
    return models.where(selection.in_apps(F.col("model"), selection.comma_list("src1,src4,src9")))


@registered("""
    WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, path FROM p
    WHERE NOT (path = '/fr' OR starts_with(path, '/fr/') OR path = '/e' OR starts_with(path, '/e/'))
""")
def path_exclude(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", urls.url_path(F.col("url")).alias("path"))
    return pages.where(selection.outside_paths(F.col("path"), ["/fr", "/e"]))


_PATTERNS = """
    SELECT CASE l_linenumber % 4 WHEN 0 THEN concat('*/', l_orderkey, '[?#]*') WHEN 1 THEN concat('http*.example.???/*/', l_orderkey)
                WHEN 2 THEN concat('*[!a-d]/', l_orderkey, '.html') ELSE concat('https://*/f?/', l_orderkey, '/') END AS pattern FROM lineitem
    UNION SELECT concat('*blog*', o_orderkey, '*top') FROM orders
    UNION SELECT concat('*.com/e?/', event_id, '*x') FROM events
    UNION SELECT url FROM pages WHERE page_id % 50 = 0
"""


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern per order line, order and event, and some whole names."""
    key = F.col("l_orderkey")
    of_line = (
        F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("*/"), key, F.lit("[?#]*")))
        .when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("http*.example.???/*/"), key))
        .when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit("*[!a-d]/"), key, F.lit(".html")))
        .otherwise(F.concat(F.lit("https://*/f?/"), key, F.lit("/")))
    )
    return (
        table(spark, sf_dir, "lineitem").select(of_line.alias("pattern"))
        .unionByName(table(spark, sf_dir, "orders").select(F.concat(F.lit("*blog*"), "o_orderkey", F.lit("*top")).alias("pattern")))
        .unionByName(table(spark, sf_dir, "events").select(F.concat(F.lit("*.com/e?/"), "event_id", F.lit("*x")).alias("pattern")))
        .unionByName(table(spark, sf_dir, "pages").where("page_id % 50 = 0").select(F.col("url").alias("pattern")))
    )


@registered(f"SELECT page_id, url FROM pages p WHERE EXISTS (SELECT 1 FROM ({_PATTERNS}) q WHERE p.url GLOB q.pattern OR p.url = q.pattern)")
def name_select_table(spark, sf_dir):
    """Pages whose URL matches one of a large table of patterns."""
    return pattern_tables.included_by(table(spark, sf_dir, "pages").select("page_id", "url"), "url", _patterns(spark, sf_dir))


@registered(f"""
    WITH q AS MATERIALIZED (SELECT DISTINCT pattern FROM ({_PATTERNS}) WHERE pattern NOT LIKE '%html')
    SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM q WHERE p.url GLOB q.pattern OR p.url = q.pattern)
""")
def name_exclude_table(spark, sf_dir):
    """Pages whose URL matches none of them, those of HTML pages left out."""
    patterns = _patterns(spark, sf_dir).where(~F.col("pattern").like("%html"))
    return pattern_tables.not_excluded_by(table(spark, sf_dir, "pages").select("page_id", "url"), "url", patterns)


@registered("""
    WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
         f AS (SELECT concat('/', c_mktsegment) AS folder FROM customer UNION SELECT concat('/en/', event_id, '/') FROM events
               UNION SELECT concat('/de/', o_orderkey) FROM orders WHERE o_orderkey % 3 = 0)
    SELECT page_id, path FROM p
    WHERE NOT EXISTS (SELECT 1 FROM f WHERE p.path = rtrim(folder, '/') OR starts_with(p.path, concat(rtrim(folder, '/'), '/')))
""")
def path_exclude_table(spark, sf_dir):
    """Pages outside a large table of folders."""
    pages = table(spark, sf_dir, "pages").select("page_id", urls.url_path(F.col("url")).alias("path"))
    folders = (
        table(spark, sf_dir, "customer").select(F.concat(F.lit("/"), "c_mktsegment").alias("folder"))
        .unionByName(table(spark, sf_dir, "events").select(F.concat(F.lit("/en/"), "event_id", F.lit("/")).alias("folder")))
        .unionByName(table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("/de/"), "o_orderkey").alias("folder")))
    )
    return pattern_tables.outside_folders(pages, "path", folders)


# == record files ==================================================================

@registered("""
    SELECT 'crm.customer' AS model, c_custkey AS pk, c_name AS name, c_nationkey AS nation,
           c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL
    SELECT 'crm.supplier', s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier
""")
def fixture_roundtrip(spark, sf_dir):
    """Two models with different fields written to one folder of files, read back and typed."""
    path = fresh_dir(spark, "records")
    customers = record_files.to_records(table(spark, sf_dir, "customer"), "crm.customer", "c_custkey")
    suppliers = record_files.to_records(table(spark, sf_dir, "supplier"), "crm.supplier", "s_suppkey")
    record_files.write_records(customers.unionByName(suppliers), path)

    both = record_files.read_records(spark, path)
    fields = "c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    customer = record_files.typed(both, "crm.customer", fields)
    supplier = record_files.typed(both, "crm.supplier", "s_name string, s_nationkey int, s_acctbal double")

    def common(df, model, name, nation, balance, segment):
        return df.select(
            F.lit(model).alias("model"),
            "pk",
            F.col(name).alias("name"),
            F.col(nation).alias("nation"),
            F.col(balance).alias("balance"),
            segment.alias("segment"),
        )

    return common(
        customer, "crm.customer", "c_name", "c_nationkey", "c_acctbal", F.col("c_mktsegment")
    ).unionByName(
        common(
            supplier, "crm.supplier", "s_name", "s_nationkey", "s_acctbal", F.lit(None).cast("string")
        )
    )


@registered("""
    SELECT event_id AS pk, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS seen, value, props FROM events
""")
def fixture_times(spark, sf_dir):
    """Times and JSON text keep every digit on the way through record files."""
    path = fresh_dir(spark, "records")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value", "props")
    made = record_files.to_records(events, "log.event", "event_id")
    record_files.write_records(made, path, by_model=True)
    back = record_files.read_model(
        spark, path, "log.event", "ts timestamp, value double, props string"
    )
    seen = F.date_format(
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")),
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    )
    return back.select("pk", seen.alias("seen"), "value", "props")


@registered("""
    SELECT page_id AS pk, 'sites.site' AS model,
           lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS domain,
           lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS name FROM pages
""")
def site_records(spark, sf_dir):
    """Site records prepared from URLs."""
    made = prepared.site_records(table(spark, sf_dir, "pages"), F.col("page_id"), F.col("url"))
    sites = record_files.typed(made, "sites.site")
    return sites.withColumn("model", F.lit("sites.site"))


@registered("""
    WITH later AS (
        SELECT o_custkey AS pk, concat('order ', o_orderkey) AS name, o_orderpriority AS status,
               o_totalprice AS amount
        FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT 'crm.customer' AS model, pk, name, status, amount FROM later
    UNION ALL
    SELECT 'crm.customer', c_custkey, c_name, c_mktsegment, c_acctbal FROM customer
    WHERE c_custkey NOT IN (SELECT pk FROM later)
""")
def fixture_upsert(spark, sf_dir):
    """Customers are loaded first; every order reloads its customer, the last one wins."""
    model = F.lit("crm.customer").alias("model")
    first = table(spark, sf_dir, "customer").select(
        model,
        F.col("c_custkey").alias("pk"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("status"),
        F.col("c_acctbal").alias("amount"),
    )
    later = table(spark, sf_dir, "orders").select(
        model,
        F.col("o_custkey").alias("pk"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("name"),
        F.col("o_orderpriority").alias("status"),
        F.col("o_totalprice").alias("amount"),
        "o_orderdate",
        "o_orderkey",
    )
    return records.load_by_key([first, later], ["model", "pk"], ["o_orderdate", "o_orderkey"])


@registered(SQL["fixture_upsert"])
def fixture_upsert_stored(spark, sf_dir):
    """The same into a stored table of customers, of which only files with a reloaded customer are rewritten."""
    model = F.lit("crm.customer").alias("model")
    first = table(spark, sf_dir, "customer").select(
        model, F.col("c_custkey").alias("pk"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("amount")
    )
    later = table(spark, sf_dir, "orders").select(
        model,
        F.col("o_custkey").alias("pk"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("name"),
        F.col("o_orderpriority").alias("status"),
        F.col("o_totalprice").alias("amount"),
        "o_orderdate",
        "o_orderkey",
    )
    store = fresh_dir(spark, "store")
    merged_store.create_store(first, store, "pk")
    merged_store.merge_into_store(spark, store, [later], ["o_orderdate", "o_orderkey"])
    return merged_store.read_store(spark, store)


@registered("""
    WITH later AS (
        SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS pk, concat('order ', o_orderkey) AS name,
               o_orderkey FROM orders),
    last AS (
        SELECT pk, name FROM later WHERE pk IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY pk ORDER BY o_orderkey DESC) = 1)
    SELECT pk, name FROM last
    UNION ALL SELECT NULL, name FROM later WHERE pk IS NULL
    UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT pk FROM last)
""")
def fixture_upsert_unkeyed(spark, sf_dir):
    """Orders without a key are records of their own; the others reload their customer."""
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pk"), F.col("c_name").alias("name"))
    later = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("pk"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("name"),
        "o_orderkey",
    )
    return records.load_by_key([first, later], ["pk"], ["o_orderkey"])


@registered("""
    SELECT 'crm.customer' AS model, c_custkey AS pk,
           CASE WHEN c_nationkey < 5 THEN upper(c_name) ELSE c_name END AS name FROM customer
    UNION ALL SELECT 'crm.supplier', s_suppkey, s_name FROM supplier
""")
def fixture_array(spark, sf_dir):
    """Array files of mixed models, a thousand keys each; files loaded later replace records."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pk"), F.col("c_name").alias("name"), "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pk"), F.col("s_name").alias("name"))
    seed = record_files.to_records(customers.drop("c_nationkey"), "crm.customer").unionByName(
        record_files.to_records(suppliers, "crm.supplier")
    )
    fixed = customers.where(F.col("c_nationkey") < 5).select("pk", F.upper("name").alias("name"))
    paths = [fresh_dir(spark, "arrays"), fresh_dir(spark, "arrays")]
    for path, loads in zip(paths, (seed, record_files.to_records(fixed, "crm.customer"))):
        record_files.write_arrays(loads, path, F.floor(F.col("pk") / 1000))
    loaded = seeding.load_record_files(spark, paths)
    return loaded.select("model", "pk", text.json_member(F.col("fields"), "name").alias("name"))


@registered("""
    SELECT 'crm.customer' AS model, c_custkey AS pk, concat('{"', c_name, '"}, \\', c_nationkey) AS name,
           CAST(c_nationkey AS BIGINT) AS nation FROM customer
""")
def fixture_array_split(spark, sf_dir):
    """All customers in one array file, read in ranges; names hold quotes, braces and backslashes."""
    name = F.concat(F.lit('{"'), "c_name", F.lit('"}, \\'), "c_nationkey")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pk"), name.alias("name"), F.col("c_nationkey").cast("bigint").alias("nation")
    )
    path = fresh_dir(spark, "array")
    arrays.write_array_file(record_files.to_records(customers, "crm.customer"), path)
    read = arrays.read_array_records(spark, path)
    typed = record_files.typed(read, "crm.customer", "name string, nation bigint")
    return typed.select(F.lit("crm.customer").alias("model"), "pk", "name", "nation")


@registered("""
    WITH RECURSIVE placed AS (
      SELECT concat('order ', o_orderkey) AS key, o_custkey,
             concat('order ', lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS earlier,
             lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS earlier_key
      FROM orders
    ), refs AS (
      SELECT concat('nation ', n_nationkey) AS key, concat('region ', n_regionkey) AS target FROM nation
      UNION ALL SELECT concat('customer ', c_custkey), concat('nation ', c_nationkey) FROM customer
      UNION ALL SELECT concat('supplier ', s_suppkey), concat('nation ', s_nationkey) FROM supplier
      UNION ALL SELECT key, concat('customer ', o_custkey) FROM placed
      UNION ALL SELECT key, earlier FROM placed WHERE earlier_key IS NOT NULL
    ), walk AS (
      SELECT concat('region ', r_regionkey) AS key, CAST(0 AS BIGINT) AS layer FROM region
      UNION SELECT r.key, w.layer + 1 FROM walk w JOIN refs r ON r.target = w.key
    )
    SELECT w.key, max(w.layer) AS layer,
           CAST(max(CASE WHEN b.c IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS deferred, 'ready' AS state
    FROM walk w LEFT JOIN (SELECT DISTINCT concat('customer ', o_custkey) AS c FROM orders) b ON b.c = w.key
    GROUP BY w.key
""")
def load_order_layers(spark, sf_dir):
    """Records of five tables by layer. A customer's newest order is an optional reference, so it
    can be put off; an order needs its customer and the order before it."""
    def refs(name, key, other, target, optional=False):
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{name} "), key).alias("key"), F.concat(F.lit(f"{other} "), target).alias("target"), F.lit(optional).alias("optional")
        )

    named = lambda key: F.concat(F.lit("order "), key)
    orders = table(spark, sf_dir, "orders")
    earlier = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    newest = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("newest"))
    customer = F.concat(F.lit("customer "), "o_custkey")
    chained = orders.select(named(F.col("o_orderkey")).alias("key"), customer.alias("customer"), named(earlier).alias("earlier"))
    references = (
        refs("nation", "n_nationkey", "region", "n_regionkey")
        .unionByName(refs("customer", "c_custkey", "nation", "c_nationkey"))
        .unionByName(refs("supplier", "s_suppkey", "nation", "s_nationkey"))
        .unionByName(chained.select("key", F.col("customer").alias("target"), F.lit(False).alias("optional")))
        .unionByName(chained.select("key", F.col("earlier").alias("target"), F.lit(False).alias("optional")))
        .unionByName(newest.select(customer.alias("key"), named(F.col("newest")).alias("target"), F.lit(True).alias("optional")))
    )
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey"}
    records_ = chained.select("key")
    for name, key in keys.items():
        records_ = records_.unionByName(table(spark, sf_dir, name).select(F.concat(F.lit(f"{name} "), key).alias("key")))
    return load_order.load_layers(records_, references)


@registered("""
    SELECT event_id AS pk, concat('app ', event_id) AS name, 'https://x.example.test/complete' AS redirect_uris,
           strftime(date_trunc('milliseconds', ts), '%Y-%m-%d %H:%M:%S.%g') AS created, concat('u', user_id) AS owner
    FROM events
""")
def prepared_applications(spark, sf_dir):
    """An application for each event, prepared, read back and typed."""
    events = table(spark, sf_dir, "events")
    made = prepared.application_records(
        events,
        F.col("event_id"),
        name=F.concat(F.lit("app "), F.col("event_id")),
        site_url=F.lit("https://x.example.test/"),
        redirect_path="complete",
        client_id=F.md5(F.col("event_id").cast("string")),
        client_secret=F.sha2(F.col("event_id").cast("string"), 256),
        owner=F.concat(F.lit("u"), F.col("user_id")),
        created=F.col("ts"),
    )
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("created").cast("timestamp_ntz"))
    return record_files.typed(made, "oauth2_provider.application").select(
        "pk", "name", "redirect_uris", F.date_format(utc, "yyyy-MM-dd HH:mm:ss.SSS").alias("created"),
        F.col("user")[0].alias("owner"),
    )


@registered("""
    SELECT s_suppkey AS pk, n_name AS host_name, concat('s', s_suppkey) AS name,
           concat('http://s', s_suppkey, '.example.test/') AS url, true AS active, 60 AS seconds
    FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
def prepared_services(spark, sf_dir):
    """Suppliers as monitored services on the hosts of their nations, prepared, read back and joined."""
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = F.concat(F.lit("s"), F.col("s_suppkey"))
    services = prepared.service_records(
        suppliers,
        F.col("s_suppkey"),
        name=name,
        url=urls.public_url(F.concat(name, F.lit(".example.test")), F.lit("80")),
        host=F.col("s_nationkey"),
        service_type=F.lit(1),
    )
    hosts = prepared.host_records(
        nations, F.col("n_nationkey"), name=F.col("n_name"), ip=F.lit("10.0.0.1")
    )
    return records.resolve_reference(
        record_files.typed(services, "monitoring.service"),
        record_files.typed(hosts, "monitoring.host"),
        F.col("host"),
        "pk",
        {"host_name": "name"},
    ).select(
        "pk", "host_name", "name", "url", "active",
        values.duration_seconds(F.col("check_interval")).cast("int").alias("seconds"),
    )


@registered("""
    SELECT c_custkey AS pk, c_name AS username, concat(c_custkey, '@example.test') AS email,
           true AS is_superuser, '2024-01-31 00:00:00' AS joined, 0 AS n_groups
    FROM customer
""")
def prepared_admins(spark, sf_dir):
    made = prepared.admin_records(
        table(spark, sf_dir, "customer"),
        F.col("c_custkey"),
        username=F.col("c_name"),
        email=F.concat("c_custkey", F.lit("@example.test")),
        password=F.sha2("c_name", 256),
        now=NOW,
    )
    utc = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.col("date_joined").cast("timestamp_ntz")
    )
    return record_files.typed(made, "people.Profile").select(
        "pk", "username", "email", "is_superuser", utc.cast("string").alias("joined"),
        F.size("groups").alias("n_groups"),
    )


# == references ====================================================================

@registered("""
    SELECT o_orderkey, o_custkey, c_name AS customer, c_mktsegment AS segment
    FROM orders JOIN customer ON c_custkey = o_custkey
""")
def fk_resolve(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return records.resolve_reference(
        orders,
        table(spark, sf_dir, "customer"),
        F.col("o_custkey"),
        "c_custkey",
        {"customer": "c_name", "segment": "c_mktsegment"},
    )


@registered("""
    SELECT o_orderkey, c_custkey AS customer, c_nationkey AS nation
    FROM orders JOIN customer ON c_name = concat('Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0'))
""")
def fk_natural(spark, sf_dir):
    """A natural key: an array with the name of the referred record in first place."""
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.array(name).alias("user"))
    return records.resolve_reference(
        orders,
        table(spark, sf_dir, "customer"),
        F.col("user")[0],
        "c_name",
        {"customer": "c_custkey", "nation": "c_nationkey"},
    ).drop("user")


@registered("""
    SELECT d.doc_id, d.lang, l.quality, l.toxic FROM
      (SELECT doc_id, lang, CASE WHEN lang <> 'en' THEN doc_id END AS label FROM documents) d
      LEFT JOIN labels l ON l.doc_id = d.label
""")
def fk_nullable(spark, sf_dir):
    """English documents carry no reference at all, so most references are null."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return records.resolve_reference(
        documents,
        table(spark, sf_dir, "labels"),
        F.when(F.col("lang") != "en", F.col("doc_id")),
        "doc_id",
        {"quality": "quality", "toxic": "toxic"},
        optional=True,
    )


@registered("""
    SELECT doc_id, lang, source FROM documents
    WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
""")
def fk_dangling(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return records.dangling_references(
        documents, table(spark, sf_dir, "labels"), F.col("doc_id"), "doc_id"
    )


# == snapshots and manifests =======================================================

@registered("""
    WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS path,
                      md5(concat_ws('|', p_name, p_brand, p_type, p_size)) AS md5
               FROM part),
         r AS (SELECT l_partkey, bool_or(l_returnflag = 'R' AND l_quantity > 45) AS altered
               FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_partkey),
         m AS (SELECT CAST(p_partkey AS VARCHAR) AS path,
                      md5(concat_ws('|', p_name, CASE WHEN altered THEN 'x' ELSE p_brand END, p_type, p_size)) AS md5
               FROM r JOIN part ON p_partkey = l_partkey
               UNION ALL SELECT concat('supplier ', s_suppkey), md5(s_name) FROM supplier)
    SELECT coalesce(m.path, a.path) AS path,
           CASE WHEN a.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unlisted'
                WHEN a.md5 = m.md5 THEN 'ok' ELSE 'mismatch' END AS status
    FROM a FULL JOIN m ON a.path = m.path
""")
def manifest_verify(spark, sf_dir):
    """Parts as artefacts. The manifest lists ordered parts; large returns altered the part."""
    part = table(spark, sf_dir, "part")

    def digest(brand):
        text_of_part = F.concat_ws("|", "p_name", brand, "p_type", F.col("p_size").cast("string"))
        return F.col("p_partkey").cast("string").alias("path"), F.md5(text_of_part).alias("md5")

    ordered = (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_linestatus") == "O")
        .groupBy("l_partkey")
        .agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("altered"))
    )
    listed = part.join(ordered, F.col("p_partkey") == F.col("l_partkey")).select(
        *digest(F.when(F.col("altered"), "x").otherwise(F.col("p_brand")))
    )
    gone = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supplier "), F.col("s_suppkey")).alias("path"), F.md5("s_name").alias("md5")
    )
    return manifests.verify_manifest(part.select(*digest(F.col("p_brand"))), listed.unionByName(gone))


def _fingerprint_sql(name: str, columns: str) -> str:
    fields = ", ".join(f"'{c}', {c}" for c in columns.split())
    return f"""
        SELECT '{name}' AS name, count(*) AS n,
               CAST(sum(CAST(concat('0x', substr(md5(CAST(json_object({fields}) AS VARCHAR)), 1, 8)) AS BIGINT))
                    AS DECIMAL(38, 0)) AS fingerprint
        FROM {name}"""


_FINGERPRINTED = {
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "labels": "doc_id quality toxic",
}


@registered(" UNION ALL ".join(_fingerprint_sql(n, c) for n, c in _FINGERPRINTED.items()))
def table_fingerprint(spark, sf_dir):
    prints = [
        manifests.table_fingerprint(table(spark, sf_dir, name), *columns.split()).select(
            F.lit(name).alias("name"), "n", "fingerprint"
        )
        for name, columns in _FINGERPRINTED.items()
    ]
    return prints[0].unionByName(prints[1]).unionByName(prints[2])


def _snapshot_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "web.pages": table(spark, sf_dir, "pages"),
        "docs.documents": table(spark, sf_dir, "documents"),
        "docs.labels": table(spark, sf_dir, "labels"),
        "talk.conversations": table(spark, sf_dir, "conversations"),
    }


@registered(
    "SELECT *, true AS listed, true AS verified FROM ("
    + " UNION ALL ".join(_fingerprint_sql(n, c) for n, c in _FINGERPRINTED.items() if n != "part")
    + ")"
)
def snapshot_manifest(spark, sf_dir):
    """A snapshot of two of three apps: every file listed and verified, and what it holds."""
    root = fresh_dir(spark, "snapshots")
    tables = {f"{name}.{name}": table(spark, sf_dir, name) for name in _FINGERPRINTED}
    made = snapshots.write_snapshot(spark, tables, root, NOW, apps=["customer", "labels"])
    of_table = F.split_part("path", F.lit("."), F.lit(1)).alias("name")
    verdicts = snapshots.verify_snapshot(spark, root, made).groupBy(of_table).agg(
        F.bool_and(F.col("status") != "unlisted").alias("listed"),
        F.bool_and(F.col("status") == "ok").alias("verified"),
    )
    prints = [
        manifests.table_fingerprint(
            snapshots.read_snapshot_table(spark, root, made, f"{name}.{name}"), *_FINGERPRINTED[name].split()
        ).select(F.lit(name).alias("name"), "n", "fingerprint")
        for name in ("customer", "labels")
    ]
    return prints[0].unionByName(prints[1]).join(verdicts, "name")


@registered("""
    SELECT 'docs.documents' AS name, doc_id AS id FROM documents
    UNION ALL SELECT 'docs.labels', doc_id FROM labels
    UNION ALL SELECT 'web.pages', page_id FROM pages
""")
def snapshot_contents(spark, sf_dir):
    """What the newest snapshot holds: the listed apps whole, the others not at all."""
    root = fresh_dir(spark, "snapshots")
    tables = _snapshot_tables(spark, sf_dir)
    snapshots.write_snapshot(spark, {"docs.labels": tables["docs.labels"]}, root, datetime(2024, 1, 30))
    snapshots.write_snapshot(spark, tables, root, NOW, apps=["docs", "web"])
    newest = snapshots.newest_snapshot(spark, root).first()
    ids = {"docs.documents": "doc_id", "docs.labels": "doc_id", "web.pages": "page_id"}
    out = None
    for name in newest.tables:
        part = snapshots.read_snapshot_table(spark, root, newest.path, name).select(
            F.lit(name).alias("name"), F.col(ids[name]).alias("id")
        )
        out = part if out is None else out.unionByName(part)
    return out


@registered("""
    SELECT page_id, replace(url, '.example.com', '.example.test') AS url,
           replace(html, '.example.com', '.example.test') AS html FROM pages
""")
def checked_restore(spark, sf_dir):
    """Pages restored from a snapshot over a store that held conversations, URLs rewritten."""
    base = fresh_dir(spark, "restore")
    tables = _snapshot_tables(spark, sf_dir)
    snapshots.write_snapshot(spark, tables, f"{base}/snapshots", NOW, apps=["web"])
    restore.publish(spark, {"talk.conversations": tables["talk.conversations"]}, f"{base}/store")
    restore.checked_restore(
        spark, f"{base}/snapshots", f"{base}/store", ".example.com", ".example.test", NOW
    )
    return restore.current_tables(spark, f"{base}/store")["web.pages"]


# == retention =====================================================================

def _backup_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as backup files: a folder per user, named by the event."""
    folder = F.concat(F.lit("/backup/"), F.col("user_id"))
    return table(spark, sf_dir, "events").select(
        folder.alias("folder"),
        F.concat(folder, F.lit("/"), F.when(F.col("event_type") == "error", "old/").otherwise(""),
                 F.col("event_id"), F.lit(".zip")).alias("path"),
        F.col("ts").alias("mtime"),
    )


@registered("""
    WITH files AS (SELECT concat('/backup/', user_id) AS folder,
                          concat('/backup/', user_id, '/', event_id, '.zip') AS path,
                          CAST(floor(epoch(ts)) AS BIGINT) AS mtime_second
                   FROM events WHERE event_type <> 'error')
    SELECT folder, path, mtime_second FROM files
    QUALIFY row_number() OVER (PARTITION BY folder ORDER BY mtime_second DESC, path DESC) = 1
""")
def latest_snapshot(spark, sf_dir):
    """Newest archive directly in each folder; those in a subfolder do not count."""
    files = _backup_files(spark, sf_dir)
    return retention.latest_per_folder(
        files.where(retention.direct_file(F.col("path"), F.col("folder")))
    )


def _retention_sql(ranked: str) -> str:
    return f"""
        WITH files AS (SELECT event_type AS folder, CAST(event_id AS VARCHAR) AS path, ts AS mtime FROM events),
             expired AS (SELECT * FROM files WHERE mtime <= TIMESTAMP '2024-01-23'),
             spared AS (SELECT * FROM {ranked}
                        QUALIFY row_number() OVER (PARTITION BY folder ORDER BY mtime DESC, path DESC) <= 3)
        SELECT * FROM expired WHERE (folder, path) NOT IN (SELECT (folder, path) FROM spared)"""


def _typed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("folder"),
        F.col("event_id").cast("string").alias("path"),
        F.col("ts").alias("mtime"),
    )


@registered(_retention_sql("expired"))
def retention_expire(spark, sf_dir):
    return retention.expired_files(_typed_files(spark, sf_dir), NOW, days=7)


@registered(_retention_sql("files"))
def retention_expire_all(spark, sf_dir):
    return retention.expired_files(_typed_files(spark, sf_dir), NOW, days=7, keep_scope="all")


@registered("""
    SELECT event_id, event_type, ts AS ctime FROM events
    WHERE event_type IN ('view', 'click') AND epoch(TIMESTAMP '2024-01-31') - epoch(ts) >= 31 * 86400 - 86400 * 20
""")
def retention_dirs(spark, sf_dir):
    dirs = table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.col("ts").alias("ctime"),
        F.when(F.col("event_type").isin("view", "click"), "d").otherwise("f").alias("kind"),
    )
    return retention.expired_dirs(dirs, NOW, days=10).drop("kind")


@registered("""
    WITH files AS (SELECT concat('/b', CASE event_type WHEN 'error' THEN '/sub/' WHEN 'click' THEN '/.' ELSE '/' END,
                                 event_id) AS path, event_type, ts AS mtime
                   FROM events),
         expired AS (SELECT * FROM files WHERE event_type NOT IN ('error', 'signup') AND mtime <= TIMESTAMP '2024-01-23')
    SELECT path, mtime FROM expired
    QUALIFY row_number() OVER (ORDER BY mtime DESC, path DESC) > 3
""")
def retention_depth(spark, sf_dir):
    """Plain files directly in the backup folder, hidden ones too; sign-ups are folders."""
    kind = F.col("event_type")
    below = F.when(kind == "error", "/sub/").when(kind == "click", "/.").otherwise("/")
    files = table(spark, sf_dir, "events").select(
        F.concat(F.lit("/b"), below, F.col("event_id")).alias("path"),
        F.col("ts").alias("mtime"),
        F.when(kind == "signup", "d").otherwise("f").alias("kind"),
    )
    return retention.expired_files(files, NOW, days=7, root="/b").drop("kind")


@registered("""
    WITH listing AS (
        SELECT concat('/b/', user_id) AS path, 'd' AS kind, max(ts) AS ctime FROM events GROUP BY user_id
        UNION ALL
        SELECT concat('/b/', user_id, CASE WHEN event_type = 'error' THEN '/old/' ELSE '/' END, event_id), 'f', ts FROM events),
    expired AS (SELECT path FROM listing WHERE kind = 'd' AND ctime <= TIMESTAMP '2024-01-30')
    SELECT l.path, l.kind, l.ctime FROM listing l JOIN expired e ON l.path = e.path OR starts_with(l.path, concat(e.path, '/'))
""")
def retention_dirs_cascade(spark, sf_dir):
    """A folder per user; those without an event on the last day go with all that they hold."""
    events = table(spark, sf_dir, "events")
    folder = F.concat(F.lit("/b/"), F.col("user_id"))
    dirs = events.groupBy(folder.alias("path")).agg(F.max("ts").alias("ctime")).withColumn("kind", F.lit("d"))
    below = F.when(F.col("event_type") == "error", "/old/").otherwise("/")
    files = events.select(
        F.concat(folder, below, F.col("event_id")).alias("path"), F.col("ts").alias("ctime"), F.lit("f").alias("kind")
    )
    return retention.expired_trees(dirs.unionByName(files), NOW, days=0)


@registered("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-24'")
def ttl_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return retention.within_ttl(events, "ts", NOW)


# == import ========================================================================

@registered("""
    SELECT event_id, user_id, value, 'vector' AS kind FROM events WHERE event_type IN ('view', 'click')
""")
def import_by_kind(spark, sf_dir):
    """Events written to one folder per kind; one kind is imported."""
    root = _import_tree(spark, sf_dir)
    return listings.import_by_kind(spark, root, "vector")


@registered("""
    SELECT event_id, user_id, value,
           CASE WHEN event_type IN ('view', 'click') THEN 'vector'
                WHEN event_type = 'error' THEN 'time' ELSE 'raster' END AS kind
    FROM events
""")
def import_all_kinds(spark, sf_dir):
    """An unknown kind stands for the whole root."""
    return listings.import_by_kind(spark, _import_tree(spark, sf_dir), "point cloud")


def _import_tree(spark: SparkSession, sf_dir: str) -> str:
    root = fresh_dir(spark, "import")
    events = table(spark, sf_dir, "events")
    groups = {
        "vector": F.col("event_type").isin("view", "click"),
        "time": F.col("event_type") == "error",
        "raster": F.coalesce(~F.col("event_type").isin("view", "click", "error"), F.lit(True)),
    }
    for kind, test in groups.items():
        events.where(test).select("event_id", "user_id", "value").write.parquet(f"{root}/{kind}")
    return root


@registered("""
    SELECT CASE WHEN event_type IN ('view', 'click') THEN 'vector'
                WHEN event_type = 'error' THEN 'time' ELSE 'raster' END AS kind,
           true AS has_files, count(*) AS n
    FROM events GROUP BY 1
""")
def import_listing(spark, sf_dir):
    """Per kind: whether the listing has its files, and the rows that they hold."""
    root = _import_tree(spark, sf_dir)
    listed = listings.list_by_kind(spark, root).where(F.endswith("path", F.lit(".parquet")))
    files = listed.groupBy("kind").agg((F.count(F.lit(1)) > 0).alias("has_files"))
    rows = listings.import_by_kind(spark, root).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(files, "kind")


@registered("""
    SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN user_id END AS user_id,
           CASE WHEN event_type NOT IN ('view', 'click') THEN value END AS value,
           CASE WHEN event_type IN ('view', 'click') THEN 'vector' ELSE 'raster' END AS kind
    FROM events
""")
def import_mixed_columns(spark, sf_dir):
    """Two kinds with different columns; importing the root keeps the columns of both."""
    root = fresh_dir(spark, "import")
    events = table(spark, sf_dir, "events")
    vector = F.coalesce(F.col("event_type").isin("view", "click"), F.lit(False))
    events.where(vector).select("event_id", "user_id").write.parquet(f"{root}/vector")
    events.where(~vector).select("event_id", "value").write.parquet(f"{root}/raster")
    return listings.import_by_kind(spark, root).select("event_id", "user_id", "value", "kind")


@registered("""
    WITH l AS (SELECT o_orderkey AS item, max(l_shipdate) AS local_time, bool_or(l_quantity = 50) AS corrupt
               FROM orders JOIN lineitem ON l_orderkey = o_orderkey
               WHERE o_orderstatus <> 'P' GROUP BY o_orderkey)
    SELECT o.o_orderkey AS item,
           CASE WHEN o.o_orderpriority = '5-LOW' AND o.o_totalprice < 100000 THEN 'absent'
                WHEN o.o_orderpriority = '5-LOW' THEN 'copy'
                WHEN l.item IS NULL OR l.corrupt THEN 'fetch'
                WHEN o.o_orderdate < l.local_time THEN 'skip' ELSE 'fetch' END AS action
    FROM orders o LEFT JOIN l ON l.item = o.o_orderkey
""")
def ingest_plan(spark, sf_dir):
    """Orders as sources, their lines as local copies; low priority comes as local files."""
    orders = table(spark, sf_dir, "orders")
    source = orders.select(
        F.col("o_orderkey").alias("item"),
        F.col("o_orderdate").alias("source_time"),
        (F.col("o_orderpriority") == "5-LOW").alias("is_file"),
        (F.col("o_totalprice") >= 100000).alias("exists"),
    )
    local = (
        table(spark, sf_dir, "lineitem")
        .join(orders.where(F.col("o_orderstatus") != "P"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_orderkey").alias("item"))
        .agg(
            F.max("l_shipdate").alias("local_time"),
            F.bool_or(F.col("l_quantity") == 50).alias("corrupt"),
        )
    )
    return ingest.ingest_plan(source, local).select("item", "action")


@registered("""
    SELECT doc_id, n_chars AS expected, octet_length(encode(text)) AS written FROM documents
    WHERE n_chars IS NULL OR n_chars = 0 OR n_chars = octet_length(encode(text))
""")
def size_check(spark, sf_dir):
    """Characters against bytes: only texts in plain ASCII were written in full."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("n_chars").alias("expected"),
        F.octet_length("text").cast("bigint").alias("written"),
    )
    return ingest.accepted_by_size(documents, "expected", "written")


# == metrics =======================================================================

@registered("""
    SELECT date_trunc('minute', ts) AS window_start, event_type AS service, count(*) AS n,
           round(sum(value), 2) AS total, min(value) AS least, max(value) AS greatest
    FROM events GROUP BY ALL
""")
def monitor_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("service"), "value")
    return counts.metric_windows(events).withColumn("total", F.round("total", 2))


@registered("""
    SELECT date_trunc('minute', ts) AS window_start, event_type, count(*) AS n,
           round(sum(value), 2) AS total, min(value) AS least, max(value) AS greatest
    FROM events
    WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE
          <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR
    GROUP BY ALL
""")
def monitor_windows_stream(spark, sf_dir):
    """The same windows from a stream over the files: those an hour behind the last event."""
    path = fresh_dir(spark, "metrics")
    source = f"{sf_dir}/events.parquet"
    query = monitoring.run_metric_stream(
        spark,
        # As a pattern, because a stream refuses the path of a single file.
        source.replace("events.parquet", "events.[p]arquet"),
        spark.read.parquet(source).schema,
        f"{path}/windows",
        f"{path}/progress",
        lateness="1 hour",
        service="event_type",
    )
    query.awaitTermination()
    windows = spark.read.parquet(f"{path}/windows")
    start = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.col("window_start").cast("timestamp_ntz")
    )
    return windows.withColumn("window_start", start).withColumn("total", F.round("total", 2))


@registered("""
    WITH checks AS (
      SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following,
             CASE user_id % 3 WHEN 0 THEN 21600 WHEN 1 THEN 43200 ELSE 86400 END AS seconds
      FROM events
    ), closed AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS until FROM events),
    dues AS (
      SELECT user_id, seconds, ts, following, unnest(range(1, 604800 // seconds + 1)) AS missed FROM checks
    )
    SELECT CAST(user_id AS VARCHAR) AS service, CAST(seconds AS BIGINT) AS check_interval, ts AS last_check, missed,
           ts + to_seconds(missed * seconds) AS due
    FROM dues, closed
    WHERE (following IS NULL OR ts + to_seconds(missed * seconds) < following) AND ts + to_seconds(missed * seconds) <= until
""")
def overdue_services(spark, sf_dir):
    """Every event is a check of its user; checks missed up to an hour before the newest event."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source.replace("events.parquet", "events.[p]arquet"))
    every = F.when(F.col("user_id") % 3 == 0, "06:00:00").when(F.col("user_id") % 3 == 1, "12:00:00").otherwise("24:00:00")
    path = fresh_dir(spark, "overdue")
    checks = stream.select(F.col("user_id").alias("service"), F.col("ts").alias("last_check"), every.alias("check_interval"))
    overdue.run_overdue_stream(checks, f"{path}/missed", f"{path}/progress", lateness="1 hour").awaitTermination()
    utc = lambda c: F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz"))
    missed = spark.read.parquet(f"{path}/missed")
    return missed.withColumn("last_check", utc("last_check")).withColumn("due", utc("due"))


# == text and URL columns ==========================================================

_HOST = r"'^[a-z]+://(?:[^/?#]*@)?([^/:?#]*)'"
_PATH = r"'^[a-z]+://[^/?#]*([^?#]*)'"


@registered(f"""
    SELECT page_id, lower(regexp_extract(url, {_HOST}, 1)) AS host,
           TRY_CAST(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*:([0-9]+)(?:[/?#]|$)', 1), '') AS INTEGER) AS port,
           regexp_extract(regexp_extract(url, {_PATH}, 1), '([^/;]*)(;[^/]*)?$', 1) AS last_part
    FROM pages
""")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.url_host(url).alias("host"),
        urls.url_port(url).alias("port"),
        urls.url_last_part(url).alias("last_part"),
    )


@registered("""
    SELECT page_id, concat('m', page_id % 7, '.example.test') AS host,
           CASE WHEN page_id % 3 > 0 THEN CAST(page_id % 3 * 4000 + 80 AS INTEGER) END AS port,
           CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE '' END AS last_part
    FROM pages
""")
def url_parts_full(spark, sf_dir):
    """URLs with upper-case hosts, users, ports, parameters, queries and open ends."""
    page = F.col("page_id")
    url = F.concat(
        F.lit("HTTPS://me:pw@x@M"), page % 7, F.lit(".Example.TEST"),
        F.when(page % 3 > 0, F.concat(F.lit(":"), page % 3 * 4000 + 80)).otherwise(F.lit("")),
        F.lit("/a;b/"),
        F.when(page % 2 == 0, F.concat(page, F.lit(";v=1?q=/z"))).otherwise(F.lit("#top/part")),
    )
    made = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return made.select(
        "page_id",
        urls.url_host(F.col("url")).alias("host"),
        urls.url_port(F.col("url")).alias("port"),
        urls.url_last_part(F.col("url")).alias("last_part"),
    )


@registered("""
    SELECT page_id, replace(url, 'example.net', 'example.test') AS url,
           replace(html, 'example.net', 'example.test') AS html,
           contains(url, 'example.net') OR contains(html, 'example.net') AS changed
    FROM pages
""")
def baseurl_rewrite(spark, sf_dir):
    return urls.rewrite_base_url(table(spark, sf_dir, "pages"), "example.net", "example.test", "changed")


@registered(r"""
    WITH p AS (SELECT page_id, CASE WHEN starts_with(url, 'https') THEN html
                                    ELSE replace(html, '<h1>', '<h2>') END AS html FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(html, 'title>[^<]+') AND regexp_matches(html, '<h1>[^<]+')
           THEN regexp_replace(regexp_replace(html, 'title>[^<]+', 'title>Cost $1 \\ year'), '<h1>[^<]+', '<h1>Heading')
           ELSE html END AS html
    FROM p
""")
def first_element_rewrite(spark, sf_dir):
    """Pages without a first-level heading keep their title too."""
    html = F.when(F.startswith("url", F.lit("https")), F.col("html")).otherwise(
        F.replace("html", F.lit("<h1>"), F.lit("<h2>"))
    )
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return text.rewrite_elements(pages, "html", {"title": "Cost $1 \\ year", "<h1": "Heading"})


@registered(r"""
    SELECT page_id, CASE page_id % 3
        WHEN 0 THEN regexp_replace(html, 'title>[^<]+', 'title>Even')
        WHEN 1 THEN CASE WHEN regexp_matches(html, 'title>[^<]+') AND regexp_matches(html, 'p>[^<]+')
                         THEN regexp_replace(regexp_replace(html, 'title>[^<]+', 'title>Odd'), 'p>[^<]+', 'p>First') ELSE html END
        ELSE html END AS html
    FROM pages
""")
def element_rules_by_document(spark, sf_dir):
    """Three documents: one with one rule, one with two, one without."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    document = F.concat(F.lit("doc"), F.col("page_id") % 3)
    rules = {"doc0": {"title": "Even"}, "doc1": {"title": "Odd", "p": "First"}}
    return text.rewrite_documents(pages, "html", document, rules)


@registered("""
    SELECT doc_id, regexp_replace(replace(text, 'The', 'Every'), 'and', 'plus', 'gi') AS text FROM documents
""")
def relabel_rules(spark, sf_dir):
    rules = [text.Rule("The", "Every"), text.Rule("and", "plus", any_case=True)]
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.apply_rules(F.col("text"), rules).alias("text"))


@registered("""
    SELECT conv_id, turn, array_to_string(list_transform(string_split(concat(role, chr(10), text), chr(10)),
           lambda x: CASE WHEN x IN ('assistant', 'Assistant') THEN 'helper' ELSE x END), '|') AS labels
    FROM conversations
""")
def array_relabel(spark, sf_dir):
    """Role and lines of a turn as an array of labelled items; only exact labels are mapped."""
    lines = F.split(F.concat("role", F.lit("\n"), "text"), "\n")
    menu = F.transform(lines, lambda x: F.struct(x.alias("label")))
    new = text.relabel_items(menu, {"assistant": "helper", "Assistant": "helper"})
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(new["label"], "|").alias("labels")
    )


@registered("""
    SELECT event_id, concat(CASE WHEN port = '443' THEN 'https://' ELSE 'http://' END, 'u', user_id, '.example.test',
           CASE WHEN port IN ('80', '443') THEN '' ELSE concat(':', port) END, '/') AS url
    FROM (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN '443' WHEN 'click' THEN '80'
                 ELSE CAST(8000 + event_id % 100 AS VARCHAR) END AS port FROM events)
""")
def url_build(spark, sf_dir):
    port = (
        F.when(F.col("event_type") == "view", "443")
        .when(F.col("event_type") == "click", "80")
        .otherwise((8000 + F.col("event_id") % 100).cast("string"))
    )
    host = F.concat(F.lit("u"), F.col("user_id"), F.lit(".example.test"))
    return table(spark, sf_dir, "events").select("event_id", urls.public_url(host, port).alias("url"))


@registered("SELECT page_id, CASE WHEN url LIKE '%/' THEN url ELSE concat(url, '/') END AS url FROM pages")
def url_slash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.with_trailing_slash(F.col("url")).alias("url")
    )


@registered("""
    SELECT page_id, regexp_replace(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1),
           '^/[^/]+/(.*)$', 1), '\\.html$', '') AS stem
    FROM pages
""")
def path_stem(spark, sf_dir):
    """Path below its first folder, without the extension."""
    path = urls.url_path(F.col("url"))
    folder = F.concat(F.lit("/"), F.split_part(path, F.lit("/"), F.lit(2)))
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.relative_stem(path, folder, ".html").alias("stem")
    )


@registered("""
    SELECT doc_id, lower(split_part(text, ' ', 1)) IN ('yes', 'true', 't', '1') AS first_word,
           coalesce(lower(lang) IN ('yes', 'true', 't', '1'), false) AS lang FROM documents
    UNION ALL
    SELECT doc_id, CAST(quality AS VARCHAR) IN ('yes', 'true', 't', '1'),
           coalesce(lower(CASE WHEN toxic = 1 THEN 'Yes' END) IN ('yes', 'true', 't', '1'), false) FROM labels
""")
def text_to_bool(spark, sf_dir):
    first_word = F.substring_index("text", " ", 1)
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        text.text_to_bool(first_word).alias("first_word"),
        text.text_to_bool(F.col("lang")).alias("lang"),
    )
    labels = table(spark, sf_dir, "labels").select(
        "doc_id",
        text.text_to_bool(F.col("quality").cast("string")).alias("first_word"),
        text.text_to_bool(F.when(F.col("toxic") == 1, "Yes")).alias("lang"),
    )
    return documents.unionByName(labels)


@registered(r"""
    SELECT event_id, address, coalesce(regexp_full_match(address,
           '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}'),
           false) AS valid
    FROM (SELECT event_id, CASE WHEN event_type = 'signup' THEN NULL
                 ELSE concat(event_id % 300, '.', user_id % 260, '.0',
                             CASE WHEN event_type = 'view' THEN '1' ELSE '' END, '.7') END AS address
          FROM events)
""")
def ipv4_valid(spark, sf_dir):
    address = F.when(
        F.col("event_type") != "signup",
        F.concat(
            F.col("event_id") % 300, F.lit("."), F.col("user_id") % 260, F.lit(".0"),
            F.when(F.col("event_type") == "view", "1").otherwise(""), F.lit(".7"),
        ),
    )
    events = table(spark, sf_dir, "events").select("event_id", address.alias("address"))
    return events.withColumn("valid", values.is_ipv4(F.col("address")))


@registered("""
    SELECT event_id, CASE event_type WHEN 'view' THEN CAST(8000 + user_id AS VARCHAR)
                                     WHEN 'click' THEN CAST(user_id AS VARCHAR) || '/udp' ELSE '80' END AS port
    FROM events
""")
def port_extract(spark, sf_dir):
    """Exposed ports as JSON objects with two, one or no member; the last one counts."""
    user = F.col("user_id").cast("string")
    ports = (
        F.when(
            F.col("event_type") == "view",
            F.concat(F.lit('{"443/tcp": {}, "'), (8000 + F.col("user_id")), F.lit('/tcp": {}}')),
        )
        .when(F.col("event_type") == "click", F.concat(F.lit('{"'), user, F.lit('/udp": {}}')))
        .when(F.col("event_type") == "error", F.lit("{}"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", values.exposed_port_of_json(ports).alias("port")
    )


@registered("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM events")
def iso_millis(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", values.iso_millis(F.col("ts")).alias("at"))


@registered("""
    SELECT event_id, CASE WHEN event_type <> 'error'
                          THEN strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000),
                                        '%Y%m%d%H%M%S') END AS at
    FROM events
""")
def compact_time(spark, sf_dir):
    """Epoch seconds written as text; errors carry a text that is no number."""
    events = table(spark, sf_dir, "events")
    seconds = F.unix_seconds(values.utc_instant(events, "ts"))
    epoch = F.when(F.col("event_type") == "error", "n/a").otherwise(seconds.cast("string"))
    return events.select("event_id", values.compact_time(epoch).alias("at"))


@registered("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def split_lines(spark, sf_dir):
    return text.split_lines(table(spark, sf_dir, "documents"), "text", keep=["doc_id"])


@registered("""
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
                     ELSE user_id * 3600 + (event_id % 60) * 60 + user_id % 60 END AS seconds
    FROM events
""")
def duration_seconds(spark, sf_dir):
    def two(number):
        return F.lpad(number.cast("string"), 2, "0")

    hours = F.col("user_id").cast("string")
    spoken = F.when(F.col("event_type") == "error", "1 hour").otherwise(
        F.concat_ws(":", hours, two(F.col("event_id") % 60), two(F.col("user_id") % 60))
    )
    return table(spark, sf_dir, "events").select("event_id", values.duration_seconds(spoken).alias("seconds"))


@registered("SELECT event_id, props::json->>'k' AS k, CAST(props::json->>'k' AS BIGINT) AS number FROM events")
def json_text(spark, sf_dir):
    props = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.json_member(props, "k").alias("k"),
        text.json_entries(props)["k"].cast("bigint").alias("number"),
    )


@registered("""
    SELECT doc_id, len(string_split(text, ' ')) AS n, array_to_string(string_split(text, ' '), '|') AS items FROM documents
""")
def json_items(spark, sf_dir):
    """The words of a document written as a JSON array and read from it again."""
    array = F.to_json(F.split("text", " "))
    items = text.json_items(array)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(items).cast("bigint").alias("n"), F.array_join(items, "|").alias("items")
    )


@registered("SELECT doc_id, coalesce(doc_id % 3 = 0, false) AS valid FROM documents")
def zip_check(spark, sf_dir):
    """Texts with the end record of an archive, with one cut short, and without."""
    rest = F.when(F.col("doc_id") % 3 == 0, 18).when(F.col("doc_id") % 3 == 1, 17)
    end = F.concat(F.lit(ingest.ZIP_END_MARK), F.repeat(F.lit("0"), rest).cast("binary"))
    content = F.concat(F.col("text").cast("binary"), F.coalesce(end, F.lit(b"")))
    return table(spark, sf_dir, "documents").select("doc_id", ingest.is_zip(content).alias("valid"))
