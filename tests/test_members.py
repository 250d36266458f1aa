"""Members and the rules over them, on sources of several lines: each case once as it breaks a rule and once as it does not."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import catalog, member_catalog, members
from corpusmill.plans import members as plans

SOURCE = '''package a.b;
import x.y.Z; // {
/* class No { */
@Service("main")
@Scope(
  value = "prototype", proxy = { "a{" })
public class C<T> extends B {
    private static final Map<String, String> M = Map.of("a", "{");
    @Autowired
    // private
    private Clock clock;
    int[] a = {1, 2}, b; int c;
    static { init(); }

    /** {@code } */
    @Transactional(readOnly = true)
    @Async
    private void go(@Valid int a,
            String b) throws IOException, X {
        if (a > 0) { run(() -> { x; }); }
        String s = """
            { not // a comment
            """;
        char q = '"', r = '}';
        new T() { void in() { } };
    }
    abstract int f(); @Bean public X x() { return new X("}"); }
    enum E { A, B; void g() {} }
    Runnable r = () -> { go(); };
    record P(int a, int b) { }
    public int last() { return 1; } /* open
    public int no() { return 1; }
    */ public int end() { return 1; }
}
interface D { void h(); }'''


def lines_of(spark, files):
    rows = [(repo, path, n, x) for (repo, path), text in files.items() for n, x in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "repo string, path string, line int, text string").repartition(3)


def test_members_of_a_file(spark):
    got = members.members(members.scoped_lines(lines_of(spark, {("r", "C.java"): SOURCE, ("r", "D.java"): "class X {\n  @A\n  int y; }"})))
    got = {(x.kind, x.name, x.owner, x.first_line, x.last_line, tuple(x.annotations)) for x in got.where("path = 'C.java'").collect()}
    assert got == {
        ("class", "C", None, 4, 7, ("Service", "Scope")), ("field", "M", "C", 8, 8, ()), ("field", "clock", "C", 9, 11, ("Autowired",)), ("field", "a", "C", 12, 12, ()), ("field", "b", "C", 12, 12, ()), ("field", "c", "C", 12, 12, ()),
        ("method", "static", "C", 13, 13, ()), ("method", "go", "C", 16, 26, ("Transactional", "Async", "Valid")), ("method", "f", "C", 27, 27, ()), ("method", "x", "C", 27, 27, ("Bean",)), ("class", "E", "C", 28, 28, ()), ("field", "B", "E", 28, 28, ()), ("method", "g", "E", 28, 28, ()),
        ("field", "r", "C", 29, 29, ()), ("class", "P", "C", 30, 30, ()), ("method", "last", "C", 31, 31, ()), ("method", "end", "C", 33, 33, ()), ("class", "D", None, 35, 35, ()), ("method", "h", "D", 35, 35, ()),
    }


def test_members_of_odd_files(spark):
    files = {("r", "a.java"): "", ("r", "b.java"): "}}}\nclass A { int x; }", ("r", "c.java"): 'class B { String s = """\n never closed', ("r", "d.java"): "class D { void f( { ", ("r", "e.java"): "/* all", (None, "f.java"): "class F { }"}
    got = {(x.path, x.kind, x.name) for x in members.members(members.scoped_lines(lines_of(spark, files))).collect()}
    assert {("b.java", "class", "A"), ("b.java", "field", "x"), ("c.java", "class", "B"), ("d.java", "class", "D"), ("f.java", "class", "F")} <= got and not any(p in ("a.java", "e.java") for p, _, _ in got)


def test_a_file_of_ten_megabytes_is_read_in_one_pass(spark):
    method = ["@Async", "/* { */ private void m%d() {", '    call("} %s", () -> {', "    });", "}"] * 1
    n = 10_000_000 // len("\n".join(method))
    rows = spark.range(n).select(F.lit("r").alias("repo"), F.lit("A.java").alias("path"), F.col("id").alias("k"), F.posexplode(F.array(*map(F.lit, method))).alias("pos", "text"))
    body = rows.select("repo", "path", (F.col("k") * 5 + F.col("pos") + 2).cast("int").alias("line"), F.replace("text", F.lit("%d"), F.col("k").cast("string")).alias("text"))
    lines = body.union(spark.createDataFrame([("r", "A.java", 1, "class A {")], body.schema)).union(spark.createDataFrame([("r", "A.java", 5 * n + 2, "}")], body.schema))
    start = time.time()
    found = members.members(members.scoped_lines(lines)).where("kind = 'method' and owner = 'A' and last_line = first_line + 4 and annotations = array('Async')")
    assert found.count() == n and time.time() - start < 120


BREAKS = {
    "SPRING_TRANSACTIONAL_ON_PRIVATE_METHOD": ("class A {\n  @Transactional\n  // public\n  private void f(\n    int a) {\n  }\n}", "class A {\n  // @Transactional\n  private void f() { }\n  @Transactional\n  public void g() { }\n}"),
    "SPRING_ASYNC_PROXY_BYPASS": ("class A {\n  @Async\n  @Override\n  private void f() { }\n}", 'class A {\n  @Async\n  void f(String s) { x("private"); }\n}'),
    "SPRING_CACHE_SELF_INVOCATION": ("class A {\n  @Cacheable(\n    'a')\n  public int f() { return 1; }\n  int g() {\n    return this.f();\n  }\n}", "class A {\n  @Cacheable\n  public int f() { return 1; }\n  int g() { return other.f(); }\n}"),
    "SPRING_TRANSACTIONAL_SELF_INVOCATION": ("class A {\n  @Transactional\n  public int f() { return 1; }\n  int g() {\n    return f();\n  }\n}", "class A {\n  @Transactional\n  public int f() { return 1; }\n}\nclass B {\n  int g() { return f(); }\n}"),
    "SPRING_BEAN_NAME_COLLISION": ('@Service(\n  "one")\nclass A { }\n@Component(value = "one")\nclass B { }', '@Service("one")\nclass A { }\n@Component("two") // "one"\nclass B { }'),
    "SPRING_PATH_VARIABLE_TEMPLATE_MISMATCH": ('class A {\n  @GetMapping("/{id}")\n  void f(\n    @PathVariable String key) { }\n}', '@RequestMapping("/{key}")\nclass A {\n  @GetMapping("/{id}")\n  void f(@PathVariable String key, @PathVariable("id") int i) { }\n}'),
    "SPRING_PROTOTYPE_BEAN_IN_SINGLETON": ('@Component\n@Scope("prototype")\nclass P { }\n@Service\nclass A {\n  private final Q q;\n  private final P p;\n}', '@Component\n@Scope("prototype")\nclass P { }\n@Service\n@Scope("prototype")\nclass A {\n  private final P p;\n}\nclass B {\n  private P p;\n}'),
    "SPRING_REQUIRES_NEW_IN_LOOP": ("class A {\n  @Transactional(\n    propagation = Propagation.REQUIRES_NEW)\n  public void one() { }\n}\nclass B {\n  void all() {\n    for (O o : os) {\n      a.one();\n    }\n  }\n}", "class A {\n  @Transactional(propagation = Propagation.REQUIRES_NEW)\n  public void one() { }\n}\nclass B {\n  void all() {\n    a.one();\n  }\n  void loop() {\n    for (O o : os) { a.two(); }\n  }\n}"),
    "SPRING_ENTITY_EXPOSED_IN_API": ('@Entity\nclass O { }\nclass A {\n  @GetMapping("/")\n  public List<O>\n    all() { return x; }\n}', '@Entity\nclass O { }\nclass A {\n  @GetMapping("/")\n  public List<Dto> all() { O o; return x; }\n  O own() { return o; }\n}'),
    "SPRING_DUPLICATE_EXCEPTION_HANDLER": ("class A {\n  @ExceptionHandler(X.class)\n  void f() { }\n  @ExceptionHandler({ Y.class,\n    X.class })\n  void g() { }\n}", "class A {\n  @ExceptionHandler(X.class)\n  void f() { }\n}\nclass B {\n  @ExceptionHandler(X.class)\n  void f() { }\n}"),
    "SPRING_TRANSACTIONAL_READONLY_WITH_WRITES": ("class A {\n  @Transactional(\n    readOnly = true)\n  public void f() {\n    repo.save(x);\n  }\n}", "class A {\n  @Transactional(readOnly = true)\n  public void f() { }\n  @Transactional\n  public void g() { repo.save(x); }\n}"),
    "SPRING_TRANSACTIONAL_ON_SCHEDULED": ("class A {\n  @Scheduled(fixedDelay = 1)\n  // then\n  @Transactional\n  public void f() { }\n}", "class A {\n  @Scheduled(fixedDelay = 1)\n  public void f() { }\n  @Transactional\n  public void g() { }\n}"),
    "SPRING_SCHEDULED_TRIGGER_MISSING_OR_CONFLICTING": ("class A {\n  @Scheduled\n  public void f() { }\n}", 'class A {\n  @Scheduled(\n    cron = "0 0 5 * * *")\n  public void f() { }\n}'),
    "SPRING_FIELD_INJECTION": ("class A {\n  @Autowired\n\n  Clock c;\n}", "class A {\n  @Autowired\n  A(Clock c) { }\n  Clock d;\n}"),
    "SPRING_REQUEST_BODY_NO_VALID": ("class A {\n  void f(@RequestBody\n    O o) { }\n  void g(@Valid O o) { }\n}", "class A {\n  void f(\n    @Valid\n    @RequestBody O o) { }\n}"),
    "SPRING_COOKIE_MISSING_HTTPONLY": ('class A {\n  void f() {\n    c = new Cookie("a", "b");\n  }\n  void g() { d.setHttpOnly(true); }\n}', 'class A {\n  void f() {\n    c = new Cookie("a", "b");\n    c.setHttpOnly( true );\n  }\n}'),
}


def test_rules_over_members(spark):
    files = {(f"{kind} {rule}", f"src/{k}.java"): text for rule, pair in BREAKS.items() for kind, text, k in zip(("breaks", "keeps"), pair, (1, 2))}
    got = {(x.repo, x.rule_id) for x in catalog.scan(lines_of(spark, files)).collect()}
    assert [r for r in BREAKS if (f"breaks {r}", r) not in got] == []
    assert [r for r in BREAKS if (f"keeps {r}", r) in got] == []


def test_names_meet_across_files_of_a_repo_alone(spark):
    bean = '@Service("x")\nclass A { }'
    moves = {("m", "db/V1__a.sql"): "create table a;\ncreate table b;", ("m", "db/V1.1__b.sql"): "x", ("n", "a/V2__a.sql"): "x", ("n", "b/V2__b.sql"): "x"}
    files = {("one", "a/A.java"): bean, ("one", "b/A.java"): bean, ("two", "a/A.java"): bean, ("three", "A.java"): bean.replace('"x"', '"y"'), ("three", "B.java"): bean, **moves}
    got = {(x.repo, x.path, x.rule_id) for x in catalog.scan(lines_of(spark, files)).where("rule_id in ('SPRING_BEAN_NAME_COLLISION', 'SPRING_FLYWAY_DUPLICATE_VERSION')").collect()}
    assert got == {("one", "a/A.java", "SPRING_BEAN_NAME_COLLISION"), ("n", "a/V2__a.sql", "SPRING_FLYWAY_DUPLICATE_VERSION")}


def test_a_clean_file_has_no_findings(spark):
    text = "package a;\n\n/** Says @Transactional, private, RestTemplate and System.out.println(1). */\npublic class A {\n    // new Random() and catch (Throwable t) { }\n    private final int a;\n\n    public A(int a) {\n        this.a = a;\n    }\n}"
    assert catalog.scan(lines_of(spark, {("r", "src/A.java"): text})).collect() == []


@pytest.mark.parametrize("t", range(len(plans.MEMBERS)))
def test_members_of_the_query_fit_their_place(t):
    kind, _, lines, _, last, broken = plans.MEMBERS[t]
    assert kind in ("method", "field") and last < len(lines) <= plans.HEIGHT and all(int(x.split()[1]) < plans.HEIGHT for x in broken)


def test_sources_are_read_once_and_facts_written_once(spark):
    lines = lines_of(spark, {("r", "C.java"): SOURCE})
    found = member_catalog.texts(members.scoped_lines(lines, ("member", "body")), lines)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(found).count("MapInArrow") == 1
    assert "MapInArrow" not in plan(member_catalog.evaluate(member_catalog.member_facts(found)))


def test_lines_and_heads_that_come_again_are_taken_apart_once(spark, monkeypatch):
    """Their results are kept, by the state that a line is met in, and no more than so many; long texts are not kept."""
    calls, lexed = [], members.lexed
    monkeypatch.setattr(members, "lexed", lambda text, state: calls.append(text) or lexed(text, state))
    monkeypatch.setattr(members, "_lines", ({}, {}, {}))
    monkeypatch.setattr(members, "KNOWN", 50)
    lines = ["class A {", "/* class B { ", "class A {", "*/", "@Async", "void f() {", '  s = """', "class A {", '  """;', "}", "// " + "x" * 300] * 40
    found = [p for scan in [members.Scan()] for n, x in enumerate(lines, 1) for p in scan.line(n, x)]
    assert len(calls) == 10 + 40 and all(len(x) <= members.SHORT for known in members._lines for x in known)
    assert [p[0] for p in found if p[2] == "head" and p[3] == "class"] == [1 + 11 * k for k in range(40)]
    for n in range(500):
        members.marked(f"int x{n};", members.CODE)
    assert len(members._lines[members.CODE]) <= 50


def test_places_of_files_at_any_cut_of_the_batches():
    import pyarrow as pa

    columns = [["r", "r", None, None, "s", "s", "s"], ["a", "a", "a", None, None, "b", "b"]]
    assert members.runs(*(pa.array(c, pa.string()) for c in columns)).tolist() == [0, 2, 3, 4, 5]
    assert members.runs(*(pa.array(c[:1], pa.string()) for c in columns)).tolist() == [0] and members.runs(*[pa.array([], pa.string())] * 2).tolist() == []


def test_annotations_are_those_of_the_head_in_one_line(spark):
    text = 'class A {\n  @A(\n  "@B {\\"@C",\n  x = @D)\n  @interface E { }\n  @F @G.H int y;\n  @I void f() { @J int z; }\n}'
    got = {x.name: x.annotations for x in members.members(members.scoped_lines(lines_of(spark, {("r", "A.java"): text}))).collect()}
    assert got["y"] == ["F", "G.H"] and got["f"] == ["I"] and ["A", "D"] in got.values()


def test_a_name_twice_in_one_head_is_no_collision(spark):
    facts = [("r", "A.java", 1, 1, 1, "bean_name", "one"), ("r", "A.java", 1, 1, 1, "bean_name", "one"), ("s", "A.java", 1, 1, 1, "bean_name", "one"), ("s", "B.java", 1, 1, 1, "bean_name", "one")]
    found = spark.createDataFrame(facts, "repo string, path string, line int, member int, class_at int, fact string, value string")
    assert [(x.repo, x.path, x.rule_id, x.value) for x in member_catalog.evaluate(found).collect()] == [("s", "A.java", "SPRING_BEAN_NAME_COLLISION", "one")]


def test_facts_come_out_of_the_scan_as_from_the_texts(spark):
    """Facts that the workers find, against patterns as Spark reads them: on the sources above, and on lines made of pieces of them and odd characters."""
    rng = random.Random(4)
    files = {(f"{kind} {rule}", f"src/{kind}.java"): text for rule, pair in BREAKS.items() for kind, text in zip(("breaks", "keeps"), pair)}
    files |= {("r", "C.java"): SOURCE, ("r", "db/V1__a.sql"): "x\ny", ("s", "V2_3__b.sql"): "", (None, "V4__c.sql"): "x", ("r", "a.txt"): "@Async", (None, "E.java"): "class E { @Async private void f() { g(); } }", ("n", None): "class F { }"}
    pieces = [w for text in files.values() for w in text.split(" ")] + ["\u00e9", "\u2028", "\x85", "\u00a0", "\x0b", "\u0130", "\u212a", "=", "$", "\r", "@Async\u00e9", "\u00b2@Bean\u00b2", "public", "final", "{", "}", ";", "(", ")", "@Scheduled", "readOnly = true", "Cookie c = new Cookie (", "\u0665"]
    files |= {("odd", f"{k}.java"): "class A {\n" + "\n".join(rng.choice(["", " ", "  "]).join(rng.choices(pieces, k=rng.randint(1, 9))).replace("\n", " ") for _ in range(60)) for k in range(40)}
    lines = lines_of(spark, files)
    java = lines.where("path like '%.java'")
    want = member_catalog.member_facts(member_catalog.texts(members.scoped_lines(java, ("member", "body")), lines)).distinct().collect()
    names = member_catalog.fact_names()
    rows = member_catalog.scoped_facts(lines).collect()
    got = [(x.repo, x.path, f.line, x.member, x.class_at, names[f.fact], f.value) for x in rows for f in x.facts]
    assert len(want) > 1000 and {tuple(x) for x in want} == {*got}
    places = [(x.repo, x.path, x.member) for x in rows]
    assert len(places) == len({*places})
    plain = spark.createDataFrame(want, "repo string, path string, line int, member int, class_at int, fact string, value string")
    found = [sorted(map(str, e.collect())) for e in (member_catalog.evaluate(plain), member_catalog.evaluate_members(member_catalog.scoped_facts(lines)))]
    assert found[0] == found[1] and len(found[0]) > 30


def test_rules_within_a_member_are_held_against_rules_that_meet(spark):
    """Those rules that bits decide give what groups of facts give, with annotations of a class, repeated facts and odd places."""
    rng, inside = random.Random(8), member_catalog.within_members(member_catalog.rules())
    names = sorted({f for r in inside for f in r["needs"] + r["none"]})
    rows = [(rng.choice(["r", "s", None]), rng.choice(["a", "b", ""]), rng.choice([1, 2, None]), m := rng.randint(1, 60), m % 7 or None, rng.choice(names), rng.choice(["x", "y", None])) for _ in range(1500)]
    rows += [("r", "a", 1, 70, 70, "transactional", None), ("r", "a", 2, 71, 70, "modifying", None), ("r", "a", 3, 72, 73, "modifying", None)]
    facts = spark.createDataFrame(rows, "repo string, path string, line int, member int, class_at int, fact string, value string")
    columns = ["repo", "path", "line", "member", "class_at", "value", "rule_id", "severity", "category"]
    want = sorted(map(str, member_catalog.satisfied(facts, inside).select(columns).collect()))
    bits = member_catalog.with_bits(member_catalog.grouped(facts), inside)
    got = sorted(map(str, member_catalog.satisfied_within(bits, inside, member_catalog._spots(inside)).select(columns).collect()))
    assert want == got and len(got) > 50 and len(inside) > 30


def test_a_member_is_one_row_and_only_facts_that_meet_are_dealt_anew(spark, monkeypatch):
    written = []
    cut = member_catalog.cut
    monkeypatch.setattr(member_catalog, "cut", lambda df: written.append(cut(df)) or written[-1])
    lines = lines_of(spark, {("r", "A.java"): "class A {\n" + "@Async @Transactional\nprivate void f() { }\n" * 20 + "}"})
    found = member_catalog.evaluate_members(member_catalog.scoped_facts(lines))
    assert written[0].count() == 21 and {x.fact for x in written[1].collect()} == {"async_member", "tx_member"}
    assert found.where("rule_id = 'SPRING_ASYNC_TRANSACTIONAL'").count() == 20
