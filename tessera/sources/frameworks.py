"""What frameworks declare in source files: routes, configuration keys, clients and providers, by patterns over their texts.

Each framework gives nodes, and references from methods that use what it injects. All of
it is expressions and joins by file or by type; no file is looked at twice for one pattern.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.fixpoint import union_all

# Frameworks in the order in which they are asked; what shows a project's use of them in a build file, an XML file or a source file; and their languages.
_SPRING_MARKS = r"@(SpringBootApplication|RestController|Controller|Service|Repository|Component|Bean|Autowired|Configuration)\b"
_DUBBO_MARKS = r"@DubboService\b|@Service\s*\(\s*(interfaceClass|interfaceName)\s*=|@DubboReference\b|@Reference\s*\(\s*(version|group|timeout|check)"


class Framework(NamedTuple):
    name: str
    build: str
    xml: str | None
    source: str
    languages: tuple[str, ...] = ("java", "kotlin")


REGISTRY = (
    Framework("spring", r"spring-boot|springframework", None, _SPRING_MARKS),
    Framework("openfeign", r"openfeign", None, r"@FeignClient\s*\("),
    Framework("dubbo", r"org\.apache\.dubbo|com\.alibaba\.dubbo|dubbo-spring-boot|dubbo-dependencies", r"dubbo:reference|dubbo:service|xmlns:dubbo", _DUBBO_MARKS),
)

# Patterns of what is declared.
_MAPPING = r'@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?"([^"]+)"'
_VALUE = r'@Value\s*\(\s*"\$\{([^}:]+)(?::[^}]*)?\}"\s*\)'
_PROPERTIES = r'@ConfigurationProperties\s*\(\s*(?:prefix\s*=\s*)?"([^"]+)"'
_CLIENT = r"@FeignClient\s*\(([^)]*)\)"
_CLIENT_MAPPED = r'@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\([^)"]*"([^"]+)"[^)]*\)\s*(?:[\w<>\[\],.?\s]+)\s+(\w+)\s*\('
_CLIENT_PLAIN = r"(?m)^\s*(?:[\w.<>]+)\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*;"
_CLIENT_FIELD = r"@(?:Autowired|Resource)\s+(?:private|protected|public)?\s*(?:final\s+)?(\w+(?:Client|Feign|Service|Api))\s+(\w+)\s*;"
_PROVIDER = r"@(?:Dubbo)?Service\s*(?:\([^)]*\))?\s*(?:public\s+)?class\s+(\w+)\s+(?:extends\s+\w+\s+)?implements\s+([\w.,\s]+)"
_METHOD = r"(?m)^\s*(?:public|private|protected)\s+(?:static\s+)?(?:synchronized\s+)?(?:<[^>]+>\s+)?([\w.<>\[\],\s]+)\s+(\w+)\s*\([^)]*\)"
_REFERENCE_FIELD = r"@(?:Dubbo)?Reference\s*(?:\([^)]*\))?\s*(?:private|protected|public)\s+(\w+(?:Service|Rpc|Api))\s+(\w+)\s*;"
_OBJECT_METHODS = ("equals", "hashCode", "toString", "clone", "finalize", "getClass", "notify", "notifyAll", "wait")
#: Of a name with this ending the nodes in such directories are meant.
CONVENTIONS = (("Service", "/service/|/impl/"), ("Controller", "/controller/"), ("Repository", "/repository/|/dao/"))
#: Lines that a method's body is looked for in from its first on, and characters before a plain method in which a mapping may stand.
BODY_LINES, BEFORE = 31, 80


def detected(files: DataFrame) -> list[str]:
    """Frameworks whose mark stands in a build file, an XML file or a source file (path, text), in the order of the registry."""
    name = F.substring_index("path", "/", -1)
    shows = [F.max(((name.isin("pom.xml", "build.gradle", "build.gradle.kts") & F.col("text").rlike(f.build)) | (F.col("path").endswith(".xml") & F.col("text").rlike(f.xml) if f.xml else F.lit(False)) | (F.col("path").rlike(r"\.(java|kt)$") & F.col("text").rlike(f.source))).cast("int")).alias(f.name) for f in REGISTRY]
    row = files.where("text IS NOT NULL").agg(*shows).first()
    return [f.name for f in REGISTRY if row[f.name]]


def applicable(language: str) -> list[str]:
    """Frameworks of a language."""
    return [f.name for f in REGISTRY if language.lower() in f.languages]


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def found(files: DataFrame, pattern: str, *names: str) -> DataFrame:
    """A row for each match in files (path, text): file_path, text, line, offset of its first character, and its groups under these names."""
    groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(f"__{n}") for i, n in enumerate(names, 1)]
    f = files.where(F.col("text").rlike(pattern)).select("path", "text", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("__m"), F.split("text", pattern, -1).alias("__rest"), *groups)
    f = f.select("*", F.posexplode("__m").alias("__k", "__one"))
    # what stands before a match: the pieces and matches before it, in turn
    before = F.array_join(F.zip_with(F.slice("__rest", F.lit(1), F.col("__k") + 1), F.slice("__m", F.lit(1), F.col("__k")), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    f = f.withColumn("__before", before)
    return f.select(F.col("path").alias("file_path"), "text", (newlines(F.col("__before")) + 1).alias("line"), F.length("__before").alias("offset"), *(F.element_at(f"__{n}", F.col("__k") + 1).alias(n) for n in names))


def _hashed(kind: str, name: Column, line: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.concat_ws(":", "file_path", F.lit(kind), name, line.cast("string")), 256), 1, 32))


def _nodes(rows: DataFrame, node_id: Column, kind: str, name: Column, qualified: Column, decorators: Column | None = None, returns: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        node_id.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qualified.alias("qualified_name"), "file_path", F.lit("java").alias("language"),
        F.col("line").cast("int").alias("start_line"), F.col("line").cast("int").alias("end_line"), none.alias("docstring"), none.alias("signature"), F.lit("PUBLIC").alias("visibility"),
        F.lit(True).alias("is_exported"), F.lit(False).alias("is_static"), F.lit(False).alias("is_abstract"),
        (decorators if decorators is not None else F.array().cast("array<string>")).alias("decorators"), (returns if returns is not None else none).alias("return_type"),
    ).dropDuplicates(["id"])


def _java(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".java")).select("path", "text")


def spring_routes(files: DataFrame) -> DataFrame:
    """Route nodes of mappings, named by verb and path."""
    r = found(_java(files), _MAPPING, "verb", "route")
    name = F.concat_ws(" ", "verb", "route")
    return _nodes(r, _hashed("ROUTE", name, F.col("line")), "route", name, F.concat("file_path", F.lit(":"), name))


def spring_values(files: DataFrame) -> DataFrame:
    """Constants for configuration keys that @Value asks for; a default after a colon isn't part of the key."""
    v = found(_java(files), _VALUE, "key")
    name = F.concat(F.lit("${"), "key", F.lit("}"))
    return _nodes(v, _hashed("CONSTANT", name, F.col("line")), "constant", name, F.concat(F.lit("config:"), "key"))


def spring_prefixes(files: DataFrame) -> DataFrame:
    """Constants for the prefixes of bound configuration classes."""
    v = found(_java(files), _PROPERTIES, "key")
    name = F.concat(F.lit("${"), "key", F.lit(".*}"))
    return _nodes(v, _hashed("CONSTANT", name, F.col("line")), "constant", name, F.concat(F.lit("config:"), "key"))


def by_convention(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, target) of references (ref_id, reference_name) to services, controllers and repositories: the node of the simple name that stands in such a directory, the least id of several."""
    simple = F.substring_index("reference_name", ".", -1)
    asked = refs.select("reference_name").distinct().withColumn("name", simple)
    ends = F.coalesce(*[F.when(F.col("name").endswith(end), F.lit(end)) for end, _ in CONVENTIONS])
    homes = union_all([nodes.where(F.col("name").endswith(end) & F.col("file_path").rlike(where) & ~F.col("kind").isin("import", "module", "file")).select("name", F.lit(end).alias("ends"), "id") for end, where in CONVENTIONS])
    best = asked.withColumn("ends", ends).where("ends IS NOT NULL").join(homes.groupBy("name", "ends").agg(F.min("id").alias("target")), ["name", "ends"])
    return refs.join(best.select("reference_name", "target"), "reference_name").select("ref_id", "target")


def clients(files: DataFrame) -> DataFrame:
    """Declared clients: file_path, line, iface, service, base path, url, and the text up to the next client."""
    c = found(_java(files), _CLIENT, "args")
    following = F.lead("offset").over(Window.partitionBy("file_path").orderBy("offset"))
    attribute = lambda n: F.regexp_extract("args", rf'\b{n}\s*=\s*"([^"]*)"', 1)
    alone = F.regexp_extract("args", r'^\s*"([^"]*)"', 1)
    c = c.withColumn("body", F.substring(F.col("text"), F.col("offset") + 1, F.coalesce(following, F.length("text")) - F.col("offset")))
    service = F.coalesce(*[F.when(x != "", x) for x in (attribute("name"), attribute("value"), alone)], F.lit("unknown"))
    return c.select("file_path", "line", F.regexp_extract("body", r"interface\s+(\w+)", 1).alias("iface"), service.alias("service"), attribute("path").alias("base"), attribute("url").alias("url"), "body").where("iface <> ''")


def _client_methods(files: DataFrame) -> DataFrame:
    """A row for each method of a client: file_path, line, iface, service, method, and the key of its route; mapped ones by verb and path, others by their name."""
    c = clients(files)
    keyed = c.withColumn("path", F.concat_ws("\x00", "file_path", "iface")).select("path", F.col("body").alias("text"))
    back = c.select(F.concat_ws("\x00", "file_path", "iface").alias("__at"), "file_path", "iface", "service", "base", F.col("line").alias("first"))
    m = found(keyed, _CLIENT_MAPPED, "verb", "route", "method").withColumnRenamed("file_path", "__at").join(back, "__at")
    mapped = m.select("file_path", (F.col("first") + F.col("line") - 1).alias("line"), "iface", "service", "method", F.concat("verb", F.lit(" "), "base", "route").alias("key"), F.lit(True).alias("mapped"))
    p = found(keyed, _CLIENT_PLAIN, "method").withColumnRenamed("file_path", "__at")
    before = F.substring(F.col("text"), F.greatest(F.col("offset") - BEFORE, F.lit(0)) + 1, F.least(F.col("offset"), F.lit(BEFORE)))
    p = p.where((F.col("method") != "interface") & ~before.rlike("@(Request|Get|Post|Put|Delete|Patch)Mapping")).join(back, "__at")
    # a match begins with the white space before the method, so its line is that of its first letter
    at = F.col("first") + F.col("line") - 1 + newlines(F.regexp_extract(F.expr("substring(text, offset + 1, 200)"), r"^(\s*)", 1))
    plain = p.select("file_path", at.alias("line"), "iface", "service", "method", F.col("method").alias("key"), F.lit(False).alias("mapped"))
    return mapped.unionByName(plain.join(mapped.select("file_path", "iface", "method"), ["file_path", "iface", "method"], "left_anti").select(*mapped.columns))


def feign_routes(files: DataFrame) -> DataFrame:
    """Route nodes of clients: interface, verb and path, and the plain methods."""
    r = _client_methods(files)
    qualified = F.concat("iface", F.lit(":"), "key")
    client = F.concat(F.lit('@FeignClient(name="'), "service", F.lit('")'))
    name = F.when(F.col("mapped"), F.concat(F.lit("FEIGN "), "key")).otherwise(F.concat(F.lit("FEIGN "), "method", F.lit("(default)")))
    return _nodes(r, F.concat(F.lit("ROUTE:"), qualified), "route", name, qualified, F.when(F.col("mapped"), F.array(client)).otherwise(F.array(client, F.lit("@RequestMapping(default)"))))


def feign_methods(files: DataFrame) -> DataFrame:
    """(iface, method, id): the route of each method of a client, the least id of several."""
    return _client_methods(files).groupBy("iface", "method").agg(F.min(F.concat(F.lit("ROUTE:"), "iface", F.lit(":"), "key")).alias("id"))


def provider_routes(files: DataFrame) -> DataFrame:
    """Route nodes of providers: each method that stands after a provider's head, under the first interface that it implements."""
    p = found(_java(files), _PROVIDER, "class", "list")
    iface = F.substring_index(F.trim(F.element_at(F.split("list", ","), 1)), ".", -1)
    p = p.select("file_path", "line", "class", iface.alias("iface"), F.substring(F.col("text"), F.col("offset") + 1, F.length("text")).alias("text"))
    keyed = p.withColumn("path", F.concat_ws("\x00", "file_path", "class"))
    m = found(keyed.select("path", "text"), _METHOD, "returns", "method").withColumnRenamed("file_path", "path").select("path", F.col("line").alias("down"), F.trim("returns").alias("returns"), "method", "text", "offset")
    m = m.withColumn("down", F.col("down") + newlines(F.regexp_extract(F.expr("substring(text, offset + 1, 200)"), r"^(\s*)", 1)))
    r = m.drop("text", "offset").join(keyed.select("path", "file_path", F.col("line").alias("first"), "class", "iface"), "path").where((F.col("method") != F.col("class")) & ~F.col("method").isin(*_OBJECT_METHODS)).withColumn("line", F.col("first") + F.col("down") - 1)
    name = F.concat(F.lit("DUBBO "), "iface", F.lit("."), "method")
    return _nodes(r, F.concat(F.lit("ROUTE:DUBBO:"), "iface", F.lit("."), "method"), "route", name, F.concat("file_path", F.lit(":"), name), F.array(F.lit("@DubboService"), F.concat(F.lit("interface="), "iface")), F.col("returns"))


def client_fields(files: DataFrame) -> DataFrame:
    """(file_path, type, field) of injected clients."""
    return found(_java(files), _CLIENT_FIELD, "type", "field").select("file_path", "type", "field").distinct()


def reference_fields(files: DataFrame) -> DataFrame:
    """(file_path, type, field) of injected remote services."""
    return found(_java(files), _REFERENCE_FIELD, "type", "field").select("file_path", "type", "field").distinct()


def bodies(files: DataFrame, methods: DataFrame) -> DataFrame:
    """(file_path, method_id, line, body): the text from each method's (id, file_path, start_line) first line on."""
    f = files.select(F.col("path").alias("file_path"), F.split("text", "\n").alias("lines"))
    m = methods.select("file_path", F.col("id").alias("method_id"), F.col("start_line").alias("line"))
    return f.join(m, "file_path").where((F.col("line") >= 1) & (F.col("line") <= F.size("lines"))).select("file_path", "method_id", "line", F.array_join(F.slice("lines", F.col("line"), F.lit(BODY_LINES)), "\n").alias("body"))


def used_fields(fields: DataFrame, method_bodies: DataFrame) -> DataFrame:
    """fields (file_path, field, ...) with the methods of their files whose bodies use them, and the first method that is called on them there, if any."""
    hit = fields.join(method_bodies, "file_path").where(F.expr("instr(body, concat(field, '.')) > 0"))
    called = F.expr(r"regexp_extract(body, concat('\\b', field, '\\.(\\w+)\\s*\\('), 1)")
    return hit.withColumn("called", F.when(called != "", called)).drop("body")


def route_key(name: Column) -> Column:
    """The type that a route's name or qualified name begins with: what stands before the first dot or colon, without the framework's name."""
    return F.regexp_extract(name, r"^(?:DUBBO |FEIGN )?([^.:]+)[.:]", 1)


def by_route_prefix(refs: DataFrame, routes: DataFrame) -> DataFrame:
    """(ref_id, target) of references (ref_id, type) to routes (id, key) of a type: an equal key instead of a prefix; the least id of several."""
    first = routes.where("key <> ''").groupBy(F.col("key").alias("type")).agg(F.min("id").alias("target"))
    return refs.select("ref_id", "type").join(first, "type").select("ref_id", "target")


def client_uses(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, line): methods that call injected clients, to the called method's route, or without it the type's first one."""
    used = used_fields(client_fields(files), bodies(files, nodes.where("kind = 'method'")))
    routes = feign_methods(files)
    exact = used.join(routes.select(F.col("iface").alias("type"), F.col("method").alias("called"), F.col("id").alias("exact")), ["type", "called"], "left")
    first = routes.groupBy(F.col("iface").alias("type")).agg(F.min("id").alias("first"))
    return exact.join(first, "type").select(F.col("method_id").alias("source"), F.coalesce("exact", "first").alias("target"), "line").distinct()


def provider_uses(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, line): methods that use injected remote services, to the first route of the service's type."""
    used = used_fields(reference_fields(files), bodies(files, nodes.where("kind = 'method'"))).withColumn("ref_id", F.concat_ws("|", "method_id", "type"))
    routes = provider_routes(files).select("id", route_key(F.col("name")).alias("key"))
    hit = by_route_prefix(used, routes)
    return used.join(hit.distinct(), "ref_id").select(F.col("method_id").alias("source"), "target", "line").distinct()


def extracted(files: DataFrame, nodes: DataFrame, names: list[str] | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Nodes that detected frameworks (or those named) declare in files (path, text), and edges (source, target, kind, line, provenance) of what nodes use of them; None and None without any."""
    which = detected(files) if names is None else names
    made, uses = [], []
    if "spring" in which:
        made += [spring_routes(files), spring_values(files)]
    if "openfeign" in which:
        made.append(feign_routes(files))
        uses.append(client_uses(files, nodes).withColumn("provenance", F.lit("framework:openfeign")))
    if "dubbo" in which:
        made.append(provider_routes(files))
        uses.append(provider_uses(files, nodes).withColumn("provenance", F.lit("framework:dubbo")))
    edges = union_all(uses).select("source", "target", F.lit("references").alias("kind"), F.col("line").cast("int").alias("line"), "provenance") if uses else None
    return (union_all(made).dropDuplicates(["id"]) if made else None), edges
