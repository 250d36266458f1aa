"""Queries over members: source files of several lines a member, dealt by the lines of orders. What each member breaks is written beside it, not taken from the patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import member_catalog as c
from corpusmill.operators import members as m
from corpusmill.plans.bindings import load, plan

HEIGHT = 8  # lines of each member, blank ones at the end
TOP = 10  # the line before the first member

# Kind, name, lines ({n}: line number in the order, {p}: the one before, {s}: supplier % 20), annotations, last line (from 0), rules broken (with the line).
# Every second one breaks nothing.
MEMBERS = [
    ("method", "t{n}", ["@Transactional", "// private void no() {", "private void t{n}(int a,", "        String b) {", '    run("}");', "}"], ["Transactional"], 5, ["SPRING_TRANSACTIONAL_ON_PRIVATE_METHOD 0"]),
    ("method", "t{n}", ["@Transactional", '/* private { " */', "public void t{n}() {", "    // private", "}"], ["Transactional"], 4, []),
    ("method", "go{n}", ["@Async", "private void go{n}() {", "    x = \"{\" + '{';", "}"], ["Async"], 3, ["SPRING_ASYNC_PROXY_BYPASS 0"]),
    ("method", "go{n}", ["@Async", "@Transactional", "public CompletableFuture<String> go{n}()", "{", "}"], ["Async", "Transactional"], 4, ["SPRING_ASYNC_TRANSACTIONAL 0"]),
    ("method", "load{n}", ["@Async", "public", "String load{n}() { return \"void\"; }"], ["Async"], 2, ["SPRING_ASYNC_NON_FUTURE_RETURN 0"]),
    ("method", "load{n}", ["@Async", "public void load{n}() {", "}"], ["Async"], 2, []),
    ("method", "find{n}", ["@Cacheable(", '    value = "a",', '    key = "#p0")', "public void find{n}(Long id) {", "}"], ["Cacheable"], 4, ["SPRING_CACHEABLE_VOID_RETURN 0"]),
    ("method", "find{n}", ['@Cacheable("a")', '@CachePut("a")', "public Order find{n}(Long id) {", "    return null;", "}"], ["Cacheable", "CachePut"], 4, ["SPRING_CACHEPUT_AND_CACHEABLE_SAME_METHOD 0"]),
    ("method", "drop{n}", ['@CacheEvict(value = "a",', "    allEntries = true)", "public void drop{n}() {", "}"], ["CacheEvict"], 3, []),
    ("method", "drop{n}", ['@CacheEvict("a")', "public void drop{n}() {", "}"], ["CacheEvict"], 2, ["SPRING_CACHE_EVICT_WITHOUT_ALL_ENTRIES 0"]),
    ("method", "tick{n}", ["@Scheduled(fixedDelay = 9)", "public void tick{n}(", "    int x) {", "}"], ["Scheduled"], 3, ["SPRING_SCHEDULED_METHOD_INVALID_SIGNATURE 0"]),
    ("method", "tick{n}", ['@Scheduled(cron = "0 0 5 * * *", zone = "UTC")', "public void tick{n}() {", "    save(int x);", "}"], ["Scheduled"], 3, []),
    ("method", "tock{n}", ["@Scheduled(fixedRate = 9)", "/**", " * @Async", " */", "@Transactional", "public void tock{n}() { }"], ["Scheduled", "Transactional"], 5, ["SPRING_TRANSACTIONAL_ON_SCHEDULED 0"]),
    ("method", "read{n}", ["@Transactional(readOnly = true)", "public Order read{n}() {", "    // orders.save(o);", "    return orders.find();", "}"], ["Transactional"], 4, []),
    ("method", "read{n}", ["@Transactional(", "    readOnly = true)", "public Order read{n}() {", "    orders.save(o);", "    return o;", "}"], ["Transactional"], 5, ["SPRING_TRANSACTIONAL_READONLY_WITH_WRITES 0"]),
    ("field", "clock{n}", ["@Autowired", "private", "Clock clock{n};"], ["Autowired"], 2, ["SPRING_FIELD_INJECTION 0"]),
    ("field", "clock{n}", ['private String clock{n} = "@Autowired";'], [], 0, []),
    ("field", "clock{n}", ["@Autowired", "private static", "Clock clock{n};"], ["Autowired"], 2, ["SPRING_INJECTION_ON_STATIC_FIELD 0"]),
    ("method", "start{n}", ["@PostConstruct", "@Transactional", "public void start{n}() {", "}"], ["PostConstruct", "Transactional"], 3, ["SPRING_TRANSACTIONAL_ON_POSTCONSTRUCT 0"]),
    ("method", "make{n}", ["public void make{n}(@RequestBody", "    @Valid Order o) {", "}"], ["RequestBody", "Valid"], 2, []),
    ("method", "make{n}", ["public void make{n}(", "    @RequestBody Order o) {", "    @Valid int x;", "}"], ["RequestBody"], 3, ["SPRING_REQUEST_BODY_NO_VALID 0"]),
    ("method", "one{n}", ['@GetMapping("/o/{id}")', "public void one{n}(", '    @PathVariable("ident") Long id) {', "}"], ["GetMapping", "PathVariable"], 3, ["SPRING_PATH_VARIABLE_TEMPLATE_MISMATCH 0 ident"]),
    ("method", "one{n}", ['@GetMapping("/o/{id}")', "public void one{n}(", "    @PathVariable Long id) {", "}"], ["GetMapping", "PathVariable"], 3, []),
    ("method", "bake{n}", ["void bake{n}() {", '    Cookie c = new Cookie("a", "b");', "    // c.setHttpOnly(true);", "    add(c);", "}"], [], 4, ["SPRING_COOKIE_MISSING_HTTPONLY 1"]),
    ("method", "bake{n}", ["void bake{n}() {", '    Cookie c = new Cookie("a", "b");', "    c.setHttpOnly(true);", "}"], [], 3, []),
    ("field", "lines{n}", ["@OneToMany(", '    mappedBy = "order")', "private List<Line> lines{n};"], ["OneToMany"], 2, []),
    ("field", "lines{n}", ["@OneToMany", "private List<Line> lines{n};", "// mappedBy ="], ["OneToMany"], 1, ["SPRING_JPA_ONETOMANY_MISSING_MAPPED_BY 0"]),
    ("method", "oh{n}", ["public final class_ oh{n}() {", "    int[] a = { 1, 2 };", "    new T() { void in() { } };", '    String s = """', '        { " not', '        """;', "}"], [], 6, []),
    ("method", "oh{n}", ['@Secured({ "A", "B" })', "private void oh{n}() {", "    for (;;) { }", "}"], ["Secured"], 3, ["SPRING_PREAUTHORIZE_ON_PRIVATE_METHOD 0"]),
    # Those that meet others by a name; what they break is worked out by the query's SQL.
    ("method", "tx{n}", ["@Transactional", "public void tx{n}() {", "}"], ["Transactional"], 2, []),
    ("method", "call{n}", ["public void call{n}() {", "    other.tx{p}();", "    this.tx{p}();", "}"], [], 3, []),
    ("method", "far{n}", ["public void far{n}() {", "    other.tx{p}();", "}"], [], 2, []),
    ("field", "dep{n}", ["private final P{s}", "    dep{n};"], [], 1, []),
    ("method", "show{n}", ['@GetMapping("/s")', "public List<E{s}>", "    show{n}() {", "}"], ["GetMapping"], 3, []),
    ("method", "oops{n}", ["@ExceptionHandler(", "    X{s}.class)", "public void oops{n}() {", "}"], ["ExceptionHandler"], 3, []),
]
TX, CALL, FIELD_, SHOW, HANDLER = len(MEMBERS) - 6, len(MEMBERS) - 5, len(MEMBERS) - 3, len(MEMBERS) - 2, len(MEMBERS) - 1

# Heads of classes by order % 5, from line 4; {o}: the order % 20, {b}: order % 2.
CLASSES = [
    ["public class C{o} {"],
    ["@Service(", '    "b{b}")', "public class S{o} {"],
    ["@RestController", "// class No {", "public class R{o}", "    extends Base {"],
    ["@Entity", "public class E{o} {"],
    ["@Component", "@Scope(", '    value = "prototype", proxyMode = TARGET)', "class P{o} {"],
]


MARKS = ("{n}", "{p}", "{s}", "{o}", "{b}")


def _cut(text):
    """A line in pieces: what stands before its mark, the mark's number (-1 none), what stands behind it."""
    found = [(text.index(mark), k) for k, mark in enumerate(MARKS) if mark in text]
    if not found:
        return F.struct(F.lit(text).alias("before"), F.lit(-1).alias("mark"), F.lit("").alias("behind"))
    [(at, k)] = found
    assert text.count(MARKS[k]) == 1, text
    return F.struct(F.lit(text[:at]).alias("before"), F.lit(k).alias("mark"), F.lit(text[at + 3 :]).alias("behind"))


def _filled(x, n, s, o):
    value = F.lit("")
    for k, v in enumerate((n, n - 1, s, o % 20, o % 2)):
        value = F.when(x["mark"] == k, v.cast("string")).otherwise(value)
    return F.when(n.isNotNull() & s.isNotNull() & o.isNotNull(), F.concat(x["before"], value, x["behind"]))


def source_lines(spark, d):
    """repo: eight neighbouring orders; a file per order, HEIGHT lines per line of it."""
    li = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    li = li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_suppkey") % 20).alias("s"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % len(MEMBERS)).alias("t"))
    repo, path = F.concat(F.lit("r"), F.floor(F.col("o") / 8)).alias("repo"), F.concat(F.lit("m"), "o", F.lit("/A.java")).alias("path")
    choose = lambda lists, k: F.element_at(F.array(*[F.array(*map(_cut, x)) for x in lists]), (k + 1).cast("int"))
    body = li.select(repo, path, "o", "n", "s", F.posexplode(choose([x[2] for x in MEMBERS], F.col("t"))).alias("k", "text"))
    body = body.select("repo", "path", (TOP + (F.col("n") - 1) * HEIGHT + F.col("k")).cast("int").alias("line"), _filled(F.col("text"), F.col("n"), F.col("s"), F.col("o")).alias("text"))
    files = li.groupBy("o").agg(F.max("n").alias("n"))
    head = files.select(repo, path, "o", F.posexplode(choose(CLASSES, F.col("o") % 5)).alias("k", "text"))
    head = head.select("repo", "path", (4 + F.col("k")).cast("int").alias("line"), _filled(F.col("text"), F.lit(0), F.lit(0), F.col("o")).alias("text"))
    first = files.select(repo, path, F.lit(1).alias("line"), F.lit("package a.b; /* class No { */").alias("text"))
    last = files.select(repo, path, (TOP + F.col("n") * HEIGHT).cast("int").alias("line"), F.lit("}").alias("text"))
    sql = files.where("o % 3 = 0").select(repo, F.concat(F.lit("db/migration/V"), F.col("o") % 2, F.lit("__"), "o", F.lit(".sql")).alias("path"), F.explode(F.array(F.lit(1), F.lit(2))).alias("line"), F.lit("create table t (id int);").alias("text"))
    return body.unionByName(head).unionByName(first).unionByName(last).unionByName(sql)


def java(lines):
    return lines.where(F.endswith("path", F.lit(".java")))


def _quoted(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


LI = f"li AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey % 20 AS s, (l_partkey * 7 + l_linenumber) % {len(MEMBERS)} AS t, concat('r', l_orderkey // 8) AS repo, concat('m', l_orderkey, '/A.java') AS path, {TOP} + (l_linenumber - 1) * {HEIGHT} AS line FROM (SELECT l_orderkey, l_linenumber, x[1] AS l_partkey, x[2] AS l_suppkey FROM (SELECT l_orderkey, l_linenumber, min((l_partkey, l_suppkey)) AS x FROM lineitem GROUP BY ALL)))"
_members = ", ".join(f"({t}, {_quoted(k)}, {_quoted(n.replace('{n}', ''))}, {_quoted(','.join(a))}, {e})" for t, (k, n, _, a, e, _) in enumerate(MEMBERS))
_broken = ", ".join(f"({t}, {_quoted(x[0])}, {x[1]}, {_quoted(x[2]) if len(x) > 2 else 'NULL'})" for t, m_ in enumerate(MEMBERS) for x in map(str.split, m_[5]))
_heads = "[" + ", ".join(_quoted(x) for x in ("C", "S", "R", "E", "P")) + "]"


@plan(
    "e1_members",
    f"""WITH {LI}, mb(t, kind, stem, annotations, last) AS (VALUES {_members}), hd AS (SELECT DISTINCT o, repo, path FROM li)
SELECT repo, path, kind, concat(stem, n) AS name, concat({_heads}[1 + o % 5], o % 20) AS owner, CAST(line AS INT) AS first_line, CAST(line + last AS INT) AS last_line, annotations FROM li JOIN mb USING (t)
UNION ALL SELECT repo, path, 'class', concat({_heads}[1 + o % 5], o % 20), NULL, 4, [4, 6, 7, 5, 7][1 + o % 5], ['', 'Service', 'RestController', 'Entity', 'Component,Scope'][1 + o % 5] FROM hd""",
)
def _(spark, d):
    found = m.members(m.scoped_lines(java(source_lines(spark, d)), ("member",)))
    return found.select("repo", "path", "kind", "name", "owner", "first_line", "last_line", F.array_join("annotations", ",").alias("annotations"))


@plan(
    "r2_member_findings",
    f"""WITH {LI}, br(t, rule_id, k, value) AS (VALUES {_broken}), own AS (SELECT repo, path, line + k AS line, rule_id, value FROM li JOIN br USING (t)),
calls AS (SELECT a.repo, a.path, a.line + 2 AS line, 'SPRING_TRANSACTIONAL_SELF_INVOCATION' AS rule_id, concat('tx', b.n) AS value FROM li a JOIN li b ON a.o = b.o AND b.n = a.n - 1 AND a.t = {CALL} AND b.t = {TX}),
beans AS (SELECT repo, min((path, 4)) AS spot, 'SPRING_BEAN_NAME_COLLISION' AS rule_id, concat('b', o % 2) AS value FROM (SELECT DISTINCT o, repo, path FROM li) WHERE o % 5 = 1 GROUP BY repo, o % 2 HAVING count(*) >= 2),
protos AS (SELECT a.repo, min((a.path, a.line)) AS spot, 'SPRING_PROTOTYPE_BEAN_IN_SINGLETON' AS rule_id, concat('P', a.s) AS value FROM li a WHERE a.t = {FIELD_} AND a.o % 5 IN (1, 2) AND EXISTS (FROM li b WHERE b.repo = a.repo AND b.o % 5 = 4 AND b.o % 20 = a.s) GROUP BY a.repo, a.s),
shown AS (SELECT a.repo, min((a.path, a.line)) AS spot, 'SPRING_ENTITY_EXPOSED_IN_API' AS rule_id, concat('E', a.s) AS value FROM li a WHERE a.t = {SHOW} AND EXISTS (FROM li b WHERE b.repo = a.repo AND b.o % 5 = 3 AND b.o % 20 = a.s) GROUP BY a.repo, a.s),
handlers AS (SELECT repo, min((path, line)) AS spot, 'SPRING_DUPLICATE_EXCEPTION_HANDLER' AS rule_id, concat('X', s) AS value FROM li WHERE t = {HANDLER} GROUP BY repo, path, s HAVING count(*) >= 2),
moves AS (SELECT repo, min((concat('db/migration/V', o % 2, '__', o, '.sql'), 1)) AS spot, 'SPRING_FLYWAY_DUPLICATE_VERSION' AS rule_id, CAST(o % 2 AS VARCHAR) AS value FROM (SELECT DISTINCT o, repo FROM li WHERE o % 3 = 0) GROUP BY repo, o % 2 HAVING count(*) >= 2),
far AS (SELECT * FROM beans UNION ALL SELECT * FROM protos UNION ALL SELECT * FROM shown UNION ALL SELECT * FROM handlers UNION ALL SELECT * FROM moves)
SELECT repo, path, CAST(line AS INT) AS line, rule_id, value FROM own UNION ALL SELECT repo, path, CAST(line AS INT), rule_id, value FROM calls UNION ALL SELECT repo, spot[1], CAST(spot[2] AS INT), rule_id, value FROM far""",
)
def _(spark, d):
    found = c.evaluate_members(c.scoped_facts(source_lines(spark, d)))
    return found.select("repo", "path", "line", "rule_id", "value")
