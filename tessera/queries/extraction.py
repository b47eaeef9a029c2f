"""Queries of extraction, frameworks and scalar functions, over sources made from the tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import predicates as P
from tessera.functions import presentation
from tessera.operators import lookup as L
from tessera.operators import resolve
from tessera.plans.graph import PropertyGraph
from tessera.plans.lineage import cut
from tessera.queries.base import many, query, table_query
from tessera.sources import frameworks, java

# a chain of classes and calls, one file for each part


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    up = F.floor(F.col("p_partkey") / 2).cast("string")
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("package parts;\n\n/** A part. */\n@GetMapping(\"/p"), k, F.lit("\")\npublic class Part"), k, F.lit(" extends Part"), up, F.lit(" implements Item {\n  private int size"), k, F.lit(" = "), F.col("p_size"), F.lit(";\n  public int fn"), k, F.lit("(int x) { return fn"), up, F.lit("(x) + size"), k, F.lit("; }\n  void make"), k, F.lit("() { new Part"), up, F.lit("(); }\n}\n"))
    return p.select(F.concat(F.lit("parts/Part"), k, F.lit(".java")).alias("path"), body.alias("text"))


_KEYS = "k AS (SELECT p_partkey AS k, CAST(floor(p_partkey / 2) AS BIGINT) AS u FROM part)"
_JAVA: dict[str, str] = {
    "x2_extracted_nodes": f"WITH {_KEYS} SELECT kind, name, qualified_name, start_line FROM (SELECT 'file' AS kind, concat('Part', k, '.java') AS name, concat('parts/Part', k, '.java') AS qualified_name, 1 AS start_line FROM k UNION ALL SELECT 'module', 'parts', 'parts', 1 FROM k UNION ALL SELECT 'class', concat('Part', k), concat('parts.Part', k), 4 FROM k UNION ALL SELECT 'field', concat('size', k), concat('parts.Part', k, '.size', k), 6 FROM k UNION ALL SELECT 'method', concat('fn', k), concat('parts.Part', k, '.fn', k), 7 FROM k UNION ALL SELECT 'method', concat('make', k), concat('parts.Part', k, '.make', k), 8 FROM k)",
    "x21_resolved_edges": f"WITH {_KEYS} SELECT source, target, kind FROM (SELECT concat('parts.Part', k) AS source, concat('parts.Part', u) AS target, 'extends' AS kind FROM k UNION ALL SELECT concat('parts.Part', k, '.fn', k), concat('parts.Part', u, '.fn', u), 'calls' FROM k UNION ALL SELECT concat('parts.Part', k, '.make', k), concat('parts.Part', u), 'instantiates' FROM k UNION ALL SELECT concat('parts.Part', k, '.fn', k), concat('parts.Part', k, '.size', k), 'references' FROM k UNION ALL SELECT concat('parts.Part', k), concat('parts.Part', k, '.', m, k), 'contains' FROM k, (SELECT unnest(['size', 'fn', 'make']) AS m))",
    "x12_docstrings": f"WITH {_KEYS} SELECT concat('parts.Part', k) AS qualified_name, 'A part.' AS docstring FROM k",
    "x17_spring_routes": f"WITH {_KEYS} SELECT concat('Get /p', k) AS name, concat('parts/Part', k, '.java') AS file_path FROM k",
}


def _nodes_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return java.graph_of(cut(java.extracted(_sources(spark, sf_dir))))


def _named_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _nodes_edges(spark, sf_dir)
    q = n.where("kind NOT IN ('file', 'module')").select("id", "qualified_name").hint("merge")
    return e.join(q.select(F.col("id").alias("source"), F.col("qualified_name").alias("s")), "source").join(q.select(F.col("id").alias("target"), F.col("qualified_name").alias("t")), "target").select(F.col("s").alias("source"), F.col("t").alias("target"), "kind")


table_query("x2_extracted_nodes", _JAVA["x2_extracted_nodes"])(lambda spark, d: _nodes_edges(spark, d)[0].select("kind", "name", "qualified_name", "start_line"))
table_query("x21_resolved_edges", _JAVA["x21_resolved_edges"])(_named_edges)
table_query("x12_docstrings", _JAVA["x12_docstrings"])(lambda spark, d: _nodes_edges(spark, d)[0].where("docstring IS NOT NULL").select("qualified_name", "docstring"))
table_query("x17_spring_routes", _JAVA["x17_spring_routes"])(lambda spark, d: frameworks.spring_routes(_sources(spark, d)).select("name", "file_path"))


def _made(spark: SparkSession, sf_dir: str, text: str, path: str) -> DataFrame:
    """Extracts of a source for each supplier, from templates of its text and path."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("n"))
    return cut(java.extracted(s.select(_filled(path).alias("path"), _filled(text).alias("text"))))



def _filled(template: str) -> F.Column:
    """The template with the supplier's key for %k and its nation's for %n."""
    return F.concat(*(F.col(x[1:]) if x in ("%k", "%n") else F.lit(x) for x in re.split(r"(%[kn])", template) if x))


_RICH = """package shop.s%n;
import java.util.List;
import shop.base.*;
/** Sells. */
@Data
public abstract class Shop%k extends Base implements Seller, Keeper<String> {
  private static final int LIMIT%k = 3;
  private boolean isOpen, closed;
  public Shop%k(int a) { super(a); }
  protected static List<String> list(int a, String b) { return helper(LIMIT%k).stream(new Item%k()); }
  void helper() { this.list(1, null); other.go%k(); }
  enum Kind { ONE, TWO }
  interface Inner extends Seller { void inner(); }
  @interface Mark { }
}
"""


def _rich(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return java.merged(_made(spark, sf_dir, _RICH, "src/Shop%k.java"))


def _rich_nodes(where: str, *columns: str):
    return lambda spark, d: _rich(spark, d)[0].where(where).select(*columns)


def _rich_refs(where: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        n, _, r = _rich(spark, d)
        return r.where(where).join(n.select(F.col("id").alias("from_node_id"), F.col("name").alias("of")), "from_node_id").select("of", "reference_name", "receiver", "line")

    return f


_S = "k AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)"
_PKG = "concat('shop.s', n, '.Shop', k)"
for _name, _run, _sql in (
    ("x3_packages", _rich_nodes("kind IN ('module', 'import')", "kind", "name", "start_line"), f"WITH {_S} SELECT 'module' AS kind, concat('shop.s', n) AS name, 1 AS start_line FROM k UNION ALL SELECT 'import', 'java.util.List', 2 FROM k UNION ALL SELECT 'import', 'shop.base.*', 3 FROM k"),
    ("x4_types", _rich_nodes("kind IN ('class', 'interface')", "kind", "name", "qualified_name", "start_line", "end_line"), f"WITH {_S} SELECT 'class' AS kind, concat('Shop', k) AS name, {_PKG} AS qualified_name, 5 AS start_line, 15 AS end_line FROM k UNION ALL SELECT 'interface', 'Inner', concat({_PKG}, '.Inner'), 13, 13 FROM k UNION ALL SELECT 'interface', 'Mark', concat({_PKG}, '.Mark'), 14, 14 FROM k"),
    ("x5_enums", _rich_nodes("kind IN ('enum', 'enum_member')", "kind", "name", "qualified_name", "is_static"), f"WITH {_S} SELECT 'enum' AS kind, 'Kind' AS name, concat({_PKG}, '.Kind') AS qualified_name, false AS is_static FROM k UNION ALL SELECT 'enum_member', v, concat({_PKG}, '.Kind.', v), true FROM k, (SELECT unnest(['ONE', 'TWO']) AS v)"),
    ("x6_methods", _rich_nodes("kind = 'method' AND docstring IS NULL", "name", "signature", "return_type"), f"WITH {_S} SELECT concat('Shop', k) AS name, concat('Shop', k, '(int a)') AS signature, NULL AS return_type FROM k UNION ALL SELECT 'list', 'list(int a , String b)', 'List<String>' FROM k UNION ALL SELECT 'helper', 'helper()', 'void' FROM k UNION ALL SELECT 'inner', 'inner()', 'void' FROM k"),
    ("x7_fields", _rich_nodes("kind IN ('field', 'constant')", "kind", "name", "return_type"), f"WITH {_S} SELECT 'constant' AS kind, concat('LIMIT', k) AS name, 'int' AS return_type FROM k UNION ALL SELECT 'field', v, 'boolean' FROM k, (SELECT unnest(['isOpen', 'closed']) AS v)"),
    ("x8_supertypes", _rich_refs("reference_kind IN ('extends', 'implements')"), f"WITH {_S} SELECT concat('Shop', k) AS of, v AS reference_name, NULL AS receiver, 6 AS line FROM k, (SELECT unnest(['Base', 'Seller', 'Keeper']) AS v) UNION ALL SELECT 'Inner', 'Seller', NULL, 13 FROM k"),
    ("x9_calls", _rich_refs("reference_kind = 'calls'"), f"WITH {_S} SELECT 'list' AS of, 'helper' AS reference_name, NULL AS receiver, 10 AS line FROM k UNION ALL SELECT 'list', 'stream', '()', 10 FROM k UNION ALL SELECT 'helper', 'list', 'this', 11 FROM k UNION ALL SELECT 'helper', concat('go', k), 'other', 11 FROM k"),
    ("x10_creations", _rich_refs("reference_kind = 'instantiates'"), f"WITH {_S} SELECT 'list' AS of, concat('Item', k) AS reference_name, NULL AS receiver, 10 AS line FROM k"),
    ("x11_reads", _rich_refs("reference_kind = 'reads' AND reference_name LIKE 'LIMIT%'"), f"WITH {_S} SELECT 'list' AS of, concat('LIMIT', k) AS reference_name, NULL AS receiver, 10 AS line FROM k"),
    ("x13_modifiers", _rich_nodes("name LIKE 'Shop%' AND kind = 'class' OR name IN ('list', 'helper') OR kind = 'field' AND name = 'isOpen'", "name", "visibility", "is_static", "is_abstract", "is_exported"), f"WITH {_S} SELECT concat('Shop', k) AS name, 'PUBLIC' AS visibility, false AS is_static, true AS is_abstract, true AS is_exported FROM k UNION ALL SELECT 'list', 'PROTECTED', true, false, true FROM k UNION ALL SELECT 'helper', 'INTERNAL', false, false, false FROM k UNION ALL SELECT 'isOpen', 'PRIVATE', false, false, false FROM k"),
    ("x14_accessors", _rich_nodes("docstring LIKE 'Synthesized%'", "name", "signature"), f"WITH {_S} SELECT name, signature FROM k, (SELECT unnest(['isOpen', 'setIsOpen', 'getClosed', 'setClosed']) AS name, unnest(['isOpen()', 'setIsOpen(boolean)', 'getClosed()', 'setClosed(boolean)']) AS signature) UNION ALL SELECT concat('getLIMIT', k), concat('getLIMIT', k, '()') FROM k UNION ALL SELECT concat('setLIMIT', k), concat('setLIMIT', k, '(int)') FROM k"),
):
    table_query(_name, _sql)(_run)

_SCRIPT = """import x from './m%k';
export class Box%k extends Base {
  open(a) { return help%k(a); }
}
function help%k(a) {
  return new Box%k(a);
}
const quick%k = (a) => help%k(a);
module.exports = { help%k };
"""


def _script(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"))
    path = F.concat(F.lit("web/box"), "k", F.when(F.col("k").cast("int") % 2 == 0, ".js").otherwise(".ts"))
    return cut(java.extracted(s.select(path.alias("path"), _filled(_SCRIPT).alias("text"))))


def _script_edges(spark: SparkSession, d: str) -> DataFrame:
    n, e = java.graph_of(_script(spark, d))
    q = n.select("id", "name").hint("merge")
    return e.where("kind <> 'contains'").join(q.select(F.col("id").alias("source"), F.col("name").alias("s")), "source").join(q.select(F.col("id").alias("target"), F.col("name").alias("t")), "target").select(F.col("s").alias("source"), F.col("t").alias("target"), "kind")


table_query("x15_script_symbols", f"WITH {_S} SELECT kind, concat(name, k) AS name, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, exported AS is_exported FROM k, (SELECT * FROM (VALUES ('class', 'Box', 2, 4, true), ('function', 'help', 5, 7, true), ('function', 'quick', 8, 8, false)) AS v(kind, name, a, b, exported))")(lambda spark, d: java.merged(_script(spark, d))[0].where("kind IN ('class', 'function')").select("kind", "name", "start_line", "end_line", "is_exported"))
table_query("x15_script_edges", f"WITH {_S} SELECT concat('box', k, CASE WHEN k % 2 = 0 THEN '.js' ELSE '.ts' END) AS source, concat('./m', k) AS target, 'imports' AS kind FROM k UNION ALL SELECT 'open', concat('help', k), 'calls' FROM k UNION ALL SELECT concat('quick', k), concat('help', k), 'calls' FROM k UNION ALL SELECT concat('help', k), concat('Box', k), 'instantiates' FROM k")(_script_edges)
table_query("x1_parsers", f"WITH {_S} SELECT concat('p/f', k, x) AS path, CASE WHEN x IN ('.py', '.tsxx') THEN 'no parser' END AS errors FROM k, (SELECT unnest(['.java', '.mjs', '.tsx', '.py', '.tsxx']) AS x)")(
    lambda spark, d: java.extracted(spark.read.parquet(f"{d}/supplier.parquet").select(F.explode(F.array(*(F.concat(F.lit("p/f"), F.col("s_suppkey").cast("string"), F.lit(x)) for x in (".java", ".mjs", ".tsx", ".py", ".tsxx")))).alias("path")).withColumn("text", F.lit(""))).select("path", "errors")
)


def _in_file(spark: SparkSession, d: str) -> DataFrame:
    n, _, r = _rich(spark, d)
    methods = n.where("kind = 'method'").select("id", "file_path", "name", "is_exported", F.col("start_line").alias("ord"))
    found = resolve.calls_in_file(r.where("reference_kind = 'calls'").select("ref_id", "file_path", F.col("reference_name").alias("name"), "receiver"), methods)
    return found.join(r.select("ref_id", "file_path", "from_node_id"), "ref_id").join(n.select(F.col("id").alias("from_node_id"), F.col("name").alias("caller")), "from_node_id").join(n.select(F.col("id").alias("target"), F.col("name").alias("callee")), "target").select("file_path", "caller", "callee")


table_query("x16_calls_in_file", f"WITH {_S} SELECT concat('src/Shop', k, '.java') AS file_path, 'list' AS caller, 'helper' AS callee FROM k UNION ALL SELECT concat('src/Shop', k, '.java'), 'helper', 'list' FROM k")(_in_file)
table_query("u5_merged_extracts", f"WITH {_KEYS}, {_S} SELECT 'node' AS of, (SELECT 6 * count(*) FROM k) AS n UNION ALL SELECT 'edge', (SELECT 5 * count(*) FROM k) UNION ALL SELECT 'extends', (SELECT count(*) FROM k)".replace(f", {_S}", ""))(
    lambda spark, d: (lambda m: m[0].agg(F.lit("node").alias("of"), F.count(F.lit(1)).alias("n")).unionByName(m[1].agg(F.lit("edge").alias("of"), F.count(F.lit(1)).alias("n"))).unionByName(m[2].where("reference_kind = 'extends'").agg(F.lit("extends").alias("of"), F.count(F.lit(1)).alias("n"))))(java.merged(java.extracted(_sources(spark, d))))
)

# frameworks: a provider, a client and their users for each supplier
_API = """@FeignClient(name = "s%k", path = "/api")
public interface Api%kClient {
  @GetMapping("/a/%k")
  String find(int i);
  // ..........................................................................................
  void plain%k(String looooooooooooooooooooooooooooooooooooooooooooooooooooooooooooooooong);
}
"""
_USER = """class User%k {
  @Autowired private Api%kClient api;
  @DubboReference private Stock%kService stock;
  @Value("${shop.%k.size:3}") String size;
  void run() { api.find(1); }
  void count() { stock.all(); }
  void none() { }
}
"""
_HOST = """@DubboService(version = "1")
public class Host%k implements Stock%kService, Other {
  public Host%k() { }
  public int all() { return 1; }
  public String toString() { return null; }
}
"""


def _framed(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"))
    rows = F.array(*(F.struct(_filled(f"{name}%k.java").alias("path"), _filled(text).alias("text")) for name, text in (("Api", _API), ("User", _USER), ("Host", _HOST))))
    return s.select(F.explode(rows).alias("x")).select("x.*")


def _uses(spark: SparkSession, d: str, f) -> DataFrame:
    files = _framed(spark, d)
    n = cut(java.merged(java.extracted(files))[0])
    return f(files, n).join(n.select(F.col("id").alias("source"), "name", "file_path"), "source").select("file_path", "name", "target", "line")


table_query("x17_spring_values", f"WITH {_S} SELECT concat('${{shop.', k, '.size}}') AS name, concat('config:shop.', k, '.size') AS qualified_name, 4 AS start_line FROM k")(lambda spark, d: frameworks.spring_values(_framed(spark, d)).select("name", "qualified_name", "start_line"))
table_query("x18_provider_routes", f"WITH {_S} SELECT concat('ROUTE:DUBBO:Stock', k, 'Service.all') AS id, concat('DUBBO Stock', k, 'Service.all') AS name, 4 AS start_line, 'int' AS return_type FROM k")(lambda spark, d: frameworks.provider_routes(_framed(spark, d)).select("id", "name", "start_line", "return_type"))
table_query("x18_provider_uses", f"WITH {_S} SELECT concat('User', k, '.java') AS file_path, 'count' AS name, concat('ROUTE:DUBBO:Stock', k, 'Service.all') AS target, 6 AS line FROM k UNION ALL SELECT concat('User', k, '.java'), 'run', concat('ROUTE:DUBBO:Stock', k, 'Service.all'), 5 FROM k")(lambda spark, d: _uses(spark, d, frameworks.provider_uses))
table_query("x19_client_routes", f"WITH {_S} SELECT concat('ROUTE:Api', k, 'Client:Get /api/a/', k) AS id, concat('FEIGN Get /api/a/', k) AS name, 3 AS start_line FROM k UNION ALL SELECT concat('ROUTE:Api', k, 'Client:plain', k), concat('FEIGN plain', k, '(default)'), 6 FROM k")(lambda spark, d: frameworks.feign_routes(_framed(spark, d)).select("id", "name", "start_line"))
table_query("x19_client_uses", f"WITH {_S} SELECT concat('User', k, '.java') AS file_path, 'run' AS name, concat('ROUTE:Api', k, 'Client:Get /api/a/', k) AS target, 5 AS line FROM k")(lambda spark, d: _uses(spark, d, frameworks.client_uses))
table_query("x20_detected", "SELECT unnest(['spring', 'openfeign', 'dubbo']) AS name")(lambda spark, d: spark.createDataFrame([(x,) for x in frameworks.detected(_framed(spark, d)) if x in frameworks.applicable("Java")], "name string"))
table_query("x22_framework_pass", f"WITH {_S} SELECT 'route' AS what, 4 * count(*) AS n FROM k UNION ALL SELECT 'constant', count(*) FROM k UNION ALL SELECT 'framework:openfeign', count(*) FROM k UNION ALL SELECT 'framework:dubbo', 2 * count(*) FROM k")(
    lambda spark, d: (lambda made: made[0].groupBy(F.col("kind").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(made[1].groupBy(F.col("provenance").alias("what")).agg(F.count(F.lit(1)).alias("n"))))((lambda files: frameworks.extracted(files, cut(java.merged(java.extracted(files))[0])))(_framed(spark, d)))
)
query("x17_conventions", "SELECT id AS ref_id, concat('svc:', id) AS target FROM nodes WHERE starts_with(id, 'supplier:')")(
    lambda g: frameworks.by_convention(g.nodes.where("id LIKE 'supplier:%'").select(F.col("id").alias("ref_id"), F.concat(F.lit("shop."), F.regexp_replace("id", ":", "_"), F.lit("Service")).alias("reference_name")), g.nodes.where("id LIKE 'supplier:%'").select(F.concat(F.lit("svc:"), "id").alias("id"), "kind", F.concat(F.regexp_replace("id", ":", "_"), F.lit("Service")).alias("name"), F.lit("shop/service/S.java").alias("file_path")).unionByName(g.nodes.where("id LIKE 'supplier:%'").select(F.concat(F.lit("a:"), "id").alias("id"), "kind", F.concat(F.regexp_replace("id", ":", "_"), F.lit("Service")).alias("name"), F.lit("shop/other/S.java").alias("file_path"))))
)


def _docs(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    d = g.nodes.where("kind = 'function'")
    return d.select(F.col("id").alias("path"), F.col("docstring").alias("text")), d.select("id", F.col("id").alias("file_path"), F.lit(2).alias("start_line"))


query("j17_used_fields", ", t AS (SELECT id, docstring, regexp_extract(docstring, '([a-z]+)\\.', 1) AS field, string_split(docstring, chr(10)) AS l FROM nodes WHERE kind = 'function') SELECT id AS method_id, field FROM t WHERE field <> '' AND len(l) >= 2 AND contains(array_to_string(l[2:32], chr(10)), concat(field, '.'))")(
    lambda g: frameworks.used_fields(_docs(g)[0].select(F.col("path").alias("file_path"), F.regexp_extract("text", r"([a-z]+)\.", 1).alias("field")).where("field <> ''"), frameworks.bodies(*_docs(g))).select("method_id", "field")
)
query("j18_route_prefix", "SELECT n.id AS ref_id, m.target FROM nodes n JOIN (SELECT split_part(qualified_name, '.', 1) AS key, min(id) AS target FROM nodes WHERE kind = 'class' AND contains(qualified_name, '.') GROUP BY 1) m ON m.key = split_part(n.qualified_name, '.', 1) WHERE n.kind = 'interface'")(
    lambda g: frameworks.by_route_prefix(g.nodes.where("kind = 'interface'").select(F.col("id").alias("ref_id"), F.substring_index("qualified_name", ".", 1).alias("type")), g.nodes.where("kind = 'class'").select("id", frameworks.route_key(F.col("qualified_name")).alias("key")))
)

# scalar functions, one query for each kind of them
many(
    ("v1_strings", lambda g: g.nodes.select("id", presentation.capitalized(F.col("name")).alias("capitalized"), presentation.title_cased(F.col("name")).alias("title"), presentation.truncated(F.col("qualified_name"), 9).alias("cut"), presentation.escape_markdown(F.concat(F.lit("`*"), "name")).alias("md"), presentation.escape_json(F.concat(F.lit('"'), "name")).alias("js")), "SELECT id, concat(upper(name[1]), substr(name, 2)) AS capitalized, concat(upper(name[1]), lower(substr(name, 2))) AS title, CASE WHEN length(qualified_name) <= 9 THEN qualified_name ELSE concat(substr(qualified_name, 1, 9), '...') END AS cut, concat('\\`\\*', name) AS md, concat('\\\"', name) AS js FROM nodes"),
    ("v2_paths", lambda g: g.nodes.select("file_path", P.name_of(F.col("file_path")).alias("name"), P.directory_of(P.name_of(F.col("file_path")), ".").alias("top"), P.directory_of(F.col("file_path")).alias("dir"), P.language_of(F.col("file_path")).alias("language"), presentation.fence(F.col("file_path")).alias("fence")).distinct(), "SELECT DISTINCT file_path, regexp_extract(file_path, '[^/]*$') AS name, '.' AS top, regexp_extract(file_path, '^(.*)/', 1) AS dir, CASE WHEN ends_with(file_path, '.java') THEN 'java' ELSE 'markdown' END AS language, CASE WHEN ends_with(file_path, '.java') THEN 'java' ELSE '' END AS fence FROM nodes"),
    ("v3_names", lambda g: g.nodes.select("id", F.substring_index("qualified_name", ".", -1).alias("simple")), "SELECT id, regexp_extract(qualified_name, '[^.]*$') AS simple FROM nodes"),
    ("v4_node_ids", lambda g: g.nodes.select("id", F.concat(F.lit("CLASS:"), F.substring(F.sha2(F.concat_ws(":", "file_path", F.lit("CLASS"), "name", F.col("start_line").cast("string")), 256), 1, 32)).alias("hash")), "SELECT id, concat('CLASS:', substr(sha256(concat(file_path, ':CLASS:', name, ':', start_line)), 1, 32)) AS hash FROM nodes"),
    ("v5_times", lambda g: g.nodes.select("id", F.unix_millis(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("start_line"))).alias("at")), "SELECT id, (1700000000 + start_line) * 1000::BIGINT AS at FROM nodes"),
    ("v6_colours", lambda g: g.nodes.select("id", presentation.colour(F.col("kind")).alias("color"), presentation.title(F.col("kind"), F.col("name"), F.col("file_path"), F.col("start_line")).alias("title")), "SELECT id, CASE kind WHEN 'module' THEN '#6b7280' WHEN 'class' THEN '#f59e0b' WHEN 'interface' THEN '#eab308' WHEN 'function' THEN '#3b82f6' WHEN 'method' THEN '#2563eb' END AS color, concat(kind, ' ', name, chr(10), file_path, ':', start_line) AS title FROM nodes"),
    ("p1_decoded", lambda g: L.decoded_nodes(L.encoded_nodes(g.nodes.select("id", "is_exported", F.when(F.col("kind") == "class", F.array("name", "kind")).otherwise(F.array().cast("array<string>")).alias("decorators")))).select("id", "is_exported", F.array_join("decorators", "|").alias("decorators")), "SELECT id, is_exported, CASE WHEN kind = 'class' THEN concat(name, '|', kind) ELSE '' END AS decorators FROM nodes"),
    ("p1_decoded_edges", lambda g: L.decoded_edges(g.edges.select("source", "target", "kind", F.to_json(F.struct(F.lit("0.95").alias("confidence"), F.col("kind").alias("by"))).alias("metadata"))).select("source", "target", "kind", F.col("metadata")["by"].alias("by")), "SELECT source, target, kind, kind AS by FROM edges"),
    ("f21_test_words", lambda g: g.nodes.where("kind = 'function'").select("id", P.mentioning_tests(F.col("docstring")).alias("explored"), P.mentioning_tests(F.col("docstring"), P.RANKED_TEST_WORDS).alias("ranked")), "SELECT id, contains(lower(docstring), 'test') OR contains(lower(docstring), 'spec') OR contains(lower(docstring), 'verify') AS explored, contains(lower(docstring), 'test') OR contains(lower(docstring), 'spec') AS ranked FROM nodes WHERE kind = 'function'"),
)
