"""Rules over members, with captured values (R2, R3, R5-R9, E3): the part of the catalogue that needs to know what belongs to what.

A fact is what a member's head, its signature (the head without annotations), a line of its body, or a file's path holds; it may carry a value, a captured
name. A rule says which facts have to meet in a member, a class, a file or a repo, which must be absent, and whether they have to meet under one
value. Derived facts are rules whose result is a fact again, so a name can be followed from one file to another.

Source files are scanned once, and a member's facts come out of the scan in one row, so rules within a member need no grouping: its facts are bits, and a
rule is a comparison of them. Only facts that meet across members are dealt anew, and groups of them are merged into bits before they meet. The same
facts can be had one a row from pieces of code (texts() and member_facts(); facts meet texts by an equi-join on words there) and given to evaluate()."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpusmill.functions.storage import cut
from corpusmill.functions.text import chosen
from corpusmill.operators.members import by_file, head_text, keep, scanned

# Name, where it is looked for, words (one of them is in the text, lower case; * for any text), value (- none, 1 the pattern's group, name the
# member's), pattern.
FACTS = r"""
transactional | head | transactional | - | @Transactional\b
tx_member | head | transactional | name | @Transactional\b
async | head | async | - | @Async\b
async_member | head | async | name | @Async\b
cacheable | head | cacheable | - | @Cacheable\b
cacheable_member | head | cacheable | name | @Cacheable\b
cache_put | head | cacheput | - | @CachePut\b
cache_any | head | cacheable,cacheevict,cacheput | - | @Cache(?:able|Evict|Put)\b
cache_evict | head | cacheevict | - | @CacheEvict\b
evict_chosen | head | allentries,key | - | @CacheEvict\s*\([^)]*\b(?:allEntries\s*=\s*true|key\s*=)
scheduled | head | scheduled | - | @Scheduled\b
trigger_bad | head | scheduled | - | @Scheduled\s*(?:\(\s*\)|[^(\s])
trigger_bad | head | scheduled | - | @Scheduled\s*\([^)]*(?:cron\s*=[^)]*fixed(?:Rate|Delay)|fixed(?:Rate|Delay)\w*\s*=[^)]*cron\s*=|fixedRate\w*\s*=[^)]*fixedDelay|fixedDelay\w*\s*=[^)]*fixedRate)
proxied | head | transactional,async,cacheable | - | @(?:Transactional|Async|Cacheable)\b
secured | head | preauthorize,postauthorize,secured,rolesallowed | - | @(?:PreAuthorize|PostAuthorize|Secured|RolesAllowed)\b
observed | head | observed,timed,counted | - | @(?:Observed|Timed|Counted)\b
observer | body | observationregistry,meterregistry | - | (?:Observation|Meter)Registry
injection | head | autowired,value,inject,resource | - | @(?:Autowired|Value|Inject|Resource)\b
autowired | head | autowired | - | @Autowired\b
post_construct | head | postconstruct | - | @PostConstruct\b
entity | head | entity | - | @Entity\b
entity_class | head | entity | name | @Entity\b
modifying | head | modifying | - | @Modifying\b
tx_listener | head | transactionaleventlistener | - | @TransactionalEventListener\b
event_listener | head | eventlistener | - | @EventListener\b
handler_of | head | exceptionhandler | 1 | @ExceptionHandler\s*\((?:value\s*=\s*)?\{?(?:[^)]*,)?\s*([A-Za-z_.]+)\.class
read_only | head | readonly | - | @Transactional\s*\([^)]*readOnly\s*=\s*true
requires_new | head | requires_new | - | Propagation\.REQUIRES_NEW|propagation\s*=\s*REQUIRES_NEW
requires_new_member | head | requires_new | name | Propagation\.REQUIRES_NEW|propagation\s*=\s*REQUIRES_NEW
rollback_for | head | rollbackfor,rollbackforclassname | - | rollbackFor
many_to_one | head | manytoone | - | @ManyToOne\b
lazy | head | lazy | - | FetchType\.LAZY|fetch\s*=\s*LAZY
one_to_many | head | onetomany | - | @OneToMany\b
mapped_by | head | mappedby,joincolumn,jointable | - | mappedBy\s*=|@JoinColumn|@JoinTable
request_body | head | requestbody | - | @RequestBody\b
model_attribute | head | modelattribute | - | @ModelAttribute\b
valid | head | valid,validated | - | @Valid(?:ated)?\b
request_mapping | head | requestmapping | - | @RequestMapping\b
mapping_method | head | requestmethod | - | RequestMethod\.|method\s*=
sensitive_param | head | requestparam | - | @RequestParam\b(?:\s*\([^)]*\))?\s*(?:final\s+)?\w+\s+\w*(?i:password|passwd|secret|token|apikey|ssn|pin)\b
path_variable | head | pathvariable | 1 | @PathVariable\s*\(\s*(?:value\s*=\s*|name\s*=\s*)?"(\w+)"
path_variable | head | pathvariable | 1 | @PathVariable\s+(?:final\s+)?[\w<>.]+\s+(\w+)
template_variable | head | getmapping,postmapping,putmapping,deletemapping,patchmapping,requestmapping | 1 | \{(\w+)(?::[^{}]*)?\}
mapped | head | getmapping,postmapping,putmapping,deletemapping,patchmapping,requestmapping | - | @(?:Get|Post|Put|Delete|Patch|Request)Mapping\b
component | head | service,component,repository,restcontroller,controller,configuration | - | @(?:Service|Component|Repository|RestController|Controller|Configuration)\b
controller | head | restcontroller,controller | - | @(?:Rest)?Controller\b
bean_name | head | service,component,repository,restcontroller,controller | 1 | @(?:Service|Component|Repository|RestController|Controller)\s*\(\s*(?:value\s*=\s*)?"(\w+)"
prototype | head | prototype,scope_prototype | - | @Scope\s*\([^)]*(?:"prototype"|SCOPE_PROTOTYPE)
prototype_class | head | prototype,scope_prototype | name | @Scope\s*\([^)]*(?:"prototype"|SCOPE_PROTOTYPE)
bean_method | head | bean | - | @Bean\b
configuration | head | configuration,springbootapplication,autoconfiguration,testconfiguration | - | @(?:Configuration|SpringBootApplication|AutoConfiguration|TestConfiguration)\b
private | signature | private | - | \bprivate\b
final | signature | final | - | ^(?:\w+\s+)*final\b
static | signature | static | - | ^(?:\w+\s+)*static\b
public | signature | public | - | ^(?:\w+\s+)*public\b
void | signature | void | - | \bvoid\s+\w+\s*\(
type | signature | class,interface,enum,record | - | ^(?:\w+\s+)*(?:class|interface|enum|record)\s
future | signature | future,completablefuture,listenablefuture,mono,flux | - | \b(?:Future|CompletableFuture|ListenableFuture|Mono|Flux)\b
takes_arguments | signature | * | - | ^[^(]*\(\s*[\w@]
returns_container | signature | list,map,set,collection | - | ^(?:\w+\s+)*(?:List|Map|Set|Collection)<[^(]*>\s+\w+\s*\(
returned_type | signature | * | 1 | ^(?:\w+\s+)*?(?:(?:ResponseEntity|List|Set|Page|Optional|Collection)<)*([A-Z]\w*)>*\s+\w+\s*\(
field_type | signature | * | 1 | ^(?:(?:private|protected|public|final|static|volatile)\s+)*([A-Z]\w*)\s+\w+\s*(?:=.*)?$
repository_field | signature | * | - | ^(?:(?:private|protected|public|final)\s+)*\w+Repository\s+\w+\s*$
static_container | signature | static | - | ^(?:\w+\s+)*static\s+(?:List|Map|Set|Collection|HashMap|ArrayList)<[^(]*$
formatter_field | signature | simpledateformat | - | ^(?:\w+\s+)*SimpleDateFormat\s+\w+\s*(?:=.*)?$
throws_checked | signature | throws | - | \bthrows\s+(?:\w+,\s*)*(?:IOException|Exception|SQLException)\b
write_call | body | save,saveall,saveandflush,delete,deleteall,deletebyid,persist,merge,remove | - | \.(?:save|saveAll|saveAndFlush|delete|deleteAll|deleteById|persist|merge|remove)\s*\(
outbound_call | body | getforobject,postforobject,exchange,retrieve | - | \.(?:getForObject|postForObject|exchange|retrieve)\s*\(
own_call | body | * | 1 | (?:^|[^.\w])(?:this\.)?([a-z]\w*)\s*\(
any_call | body | * | 1 | \b([a-z]\w*)\s*\(
loop | body | for,while,foreach | - | \b(?:for|while)\s*\(|\.forEach\s*\(
cookie_made | body | cookie | - | new Cookie\s*\(
http_only | body | sethttponly | - | \.setHttpOnly\s*\(\s*true
template_made | body | resttemplate | - | new RestTemplate\s*\(\s*\)
migration_version | path | * | 1 | (?:^|/)V([0-9]+(?:[._][0-9]+)*)__[^/]*\.sql$
"""

ANNOTATION = r"@(?!interface\b)[A-Za-z_][\w.]*\s*(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?"

# Fact, scope, facts that meet in it (its place and value are the first one's), behind ! facts that must be absent.
DERIVED = """
component_injects class field_type component ! prototype
looped_call member any_call loop
api_returns member returned_type mapped
"""

# Rule, severity, category, scope, facts as in DERIVED; = in front: they meet under one value; *n: the first one at least n times.
RULES = """
SPRING_DUPLICATE_EXCEPTION_HANDLER ERROR EXCEPTION_HANDLING class = handler_of *2
SPRING_REQUEST_BODY_NO_VALID INFO VALIDATION member request_body ! valid
SPRING_MODEL_ATTRIBUTE_NO_VALID INFO VALIDATION member model_attribute ! valid
SPRING_ASYNC_PROXY_BYPASS WARNING MAINTAINABILITY member async private ! type
SPRING_PROXY_ANNOTATION_ON_FINAL_METHOD WARNING MAINTAINABILITY member proxied final ! type
SPRING_JPA_MANYTOONE_EAGER_DEFAULT INFO PERSISTENCE member many_to_one ! lazy
SPRING_JPA_ONETOMANY_MISSING_MAPPED_BY WARNING PERSISTENCE member one_to_many ! mapped_by
SPRING_BEAN_ON_NON_CONFIGURATION WARNING MAINTAINABILITY class bean_method ! configuration
SPRING_MODIFYING_NO_TRANSACTION WARNING PERSISTENCE member modifying ! transactional
SPRING_TRANSACTIONAL_ON_SCHEDULED WARNING TRANSACTION member scheduled transactional
SPRING_REQUEST_PARAM_SENSITIVE_NAME WARNING SECURITY member sensitive_param
SPRING_FIELD_INJECTION INFO MAINTAINABILITY member autowired field_type ! static
SPRING_REQUEST_MAPPING_NO_METHOD INFO API_SURFACE member request_mapping ! mapping_method type
SPRING_CACHEABLE_VOID_RETURN ERROR CACHING member cacheable void
SPRING_CACHE_ON_PRIVATE_METHOD WARNING CACHING member cache_any private
SPRING_CACHE_SELF_INVOCATION WARNING CACHING class = own_call cacheable_member
SPRING_CACHE_EVICT_WITHOUT_ALL_ENTRIES INFO CACHING member cache_evict ! evict_chosen
SPRING_CACHEPUT_AND_CACHEABLE_SAME_METHOD WARNING CACHING member cache_put cacheable
SPRING_TRANSACTIONAL_ON_PRIVATE_METHOD ERROR TRANSACTION member transactional private ! type
SPRING_TRANSACTIONAL_READONLY_WITH_WRITES WARNING TRANSACTION member read_only write_call
SPRING_TX_EVENT_LISTENER_WRITE_LOST ERROR TRANSACTION member tx_listener write_call ! requires_new
SPRING_TRANSACTIONAL_CHECKED_EXCEPTION_NO_ROLLBACK WARNING TRANSACTION member throws_checked transactional ! rollback_for
SPRING_TRANSACTIONAL_SELF_INVOCATION WARNING TRANSACTION class = own_call tx_member
SPRING_ASYNC_TRANSACTIONAL WARNING TRANSACTION member async transactional
SPRING_PREAUTHORIZE_ON_PRIVATE_METHOD ERROR SECURITY member secured private ! type
SPRING_ASYNC_NON_FUTURE_RETURN WARNING MAINTAINABILITY member async ! void future type
SPRING_EVENT_LISTENER_NO_OBSERVABILITY INFO OBSERVABILITY member event_listener ! observed observer
SPRING_OBSERVED_ON_PRIVATE_METHOD WARNING OBSERVABILITY member observed private
SPRING_ENTITY_EXPOSED_IN_API WARNING API_SURFACE repo = api_returns entity_class
SPRING_FLYWAY_DUPLICATE_VERSION ERROR PERSISTENCE repo = migration_version *2
SPRING_EVENT_LISTENER_BLOCKING INFO SCHEDULING member event_listener outbound_call ! async
SPRING_PROTOTYPE_BEAN_IN_SINGLETON WARNING MAINTAINABILITY repo = component_injects prototype_class
SPRING_STATIC_MUTABLE_FIELD WARNING MAINTAINABILITY class static_container component
SPRING_REPOSITORY_IN_CONTROLLER WARNING MAINTAINABILITY class repository_field controller
SPRING_NON_THREAD_SAFE_FORMATTER_FIELD WARNING MAINTAINABILITY member formatter_field
SPRING_RESTTEMPLATE_NEW_PER_REQUEST WARNING HTTP member template_made mapped
SPRING_REQUIRES_NEW_IN_LOOP WARNING TRANSACTION repo = looped_call requires_new_member
SPRING_SCHEDULED_METHOD_INVALID_SIGNATURE ERROR SCHEDULING member scheduled takes_arguments
SPRING_ASYNC_SELF_INVOCATION WARNING MAINTAINABILITY class = own_call async_member
SPRING_INJECTION_ON_STATIC_FIELD ERROR MAINTAINABILITY member injection static
SPRING_TRANSACTIONAL_ON_POSTCONSTRUCT WARNING TRANSACTION member post_construct transactional
SPRING_PATH_VARIABLE_TEMPLATE_MISMATCH ERROR API_SURFACE member = path_variable ! template_variable
SPRING_COOKIE_MISSING_HTTPONLY WARNING SECURITY member cookie_made ! http_only
SPRING_BEAN_NAME_COLLISION ERROR STARTUP repo = bean_name *2
SPRING_SCHEDULED_TRIGGER_MISSING_OR_CONFLICTING ERROR SCHEDULING member trigger_bad
SPRING_JPA_FINAL_ENTITY WARNING PERSISTENCE member entity final
"""


def facts() -> list[dict]:
    """name, part, words, value, pattern of every fact."""
    rows = [line.split(" | ", 4) for line in FACTS.strip().splitlines()]
    return [{"name": n, "part": p, "words": w.split(","), "value": v, "pattern": x} for n, p, w, v, x in rows]


def _parsed(fields: list[str]) -> dict:
    scope, *rest = fields
    least = [int(x[1:]) for x in rest if x[0] == "*"]
    rest = [x for x in rest if x[0] != "*"]
    by_value = rest[0] == "="
    rest = rest[1:] if by_value else rest
    cut = rest.index("!") if "!" in rest else len(rest)
    return {"scope": scope, "by_value": by_value, "needs": rest[:cut], "none": rest[cut + 1 :], "least": least[0] if least else 1}


def derived() -> list[dict]:
    return [{"rule_id": x[0], "severity": "", "category": "", **_parsed(x[1:])} for x in map(str.split, DERIVED.strip().splitlines())]


def rules() -> list[dict]:
    """rule_id, severity, category, scope, by_value, needs, none, least of every rule."""
    return [{"rule_id": x[0], "severity": x[1], "category": x[2], **_parsed(x[3:])} for x in map(str.split, RULES.strip().splitlines())]


def used_facts() -> list[dict]:
    """Those of facts() that a rule names."""
    used = {f for r in rules() + derived() for f in r["needs"] + r["none"]}
    return [f for f in facts() if f["name"] in used]


def fact_names() -> list[str]:
    """The name of each fact by its number, derived ones behind the others."""
    return [*dict.fromkeys([*(f["name"] for f in facts()), *(r["rule_id"] for r in derived())])]


def texts(pieces: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """repo, path, line, member, class_at, name, part, text: heads, signatures and lines of bodies of scoped_lines(), and paths (repo, path)."""
    own = F.when(F.col("kind") == "class", F.col("member")).otherwise(F.col("owner_at")).alias("class_at")
    whole, field = F.col("part") == "member", F.col("kind") == "field"  # a field's value is neither an annotation nor part of what it declares
    rows = pieces.where("part in ('member', 'body')").withColumn("head", F.when(whole, head_text("code")))
    rows = rows.withColumn("lead", F.regexp_extract("head", rf"^(?:{ANNOTATION}\s*)*", 0))
    rows = rows.withColumn("rest", F.when(field, F.regexp_replace(F.substring(F.col("head"), F.length("lead") + 1, F.length("head")), "=.*$", "")))
    plain = F.trim(F.regexp_replace(F.when(field, F.col("rest")).otherwise(F.col("head")), ANNOTATION, " "))
    part = lambda name, text: F.struct(F.lit(name).alias("part"), text.alias("text"))
    head = part("head", F.when(field, F.concat("lead", "rest")).otherwise(F.col("head")))
    parts = F.when(whole, F.array(head, part("signature", F.regexp_replace(plain, r"\s+", " ")))).otherwise(F.array(part("body", F.col("code"))))
    out = rows.select("repo", "path", "line", "member", own, "name", F.explode(parts).alias("t")).select("repo", "path", "line", "member", "class_at", "name", "t.part", "t.text")
    if paths is not None:
        out = out.unionByName(path_texts(paths, out.schema["line"].dataType).select(out.columns))
    return out


def path_texts(paths: DataFrame, line) -> DataFrame:
    """Texts of paths (repo, path), each once."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("member", "int"), ("class_at", "int"), ("name", "string"))]
    return paths.select("repo", "path").distinct().select("repo", "path", F.lit(1).cast(line).alias("line"), *none, F.lit("path").alias("part"), F.col("path").cast("string").alias("text"))


@cache
def _words() -> str:
    """The characters, as ranges of a class, between which and others Java sees the bound of a word."""
    kinds = ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Mn")
    held = np.array([unicodedata.category(chr(c)) in kinds for c in range(sys.maxunicode + 1)])
    held[ord("_")] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


@cache
def java_pattern(pattern: str, plain: bool) -> re.Pattern:
    """A pattern as Java reads it: classes of ASCII characters, its ends of lines, bounds of words of any letters; plain: for texts of ASCII characters alone."""
    classes, ends = {"w": "a-zA-Z0-9_", "s": r" \t\n\x0b\f\r", "d": "0-9"}, r"\n\r\x85\u2028\u2029"
    bound = r"\b" if plain else f"(?:(?<=[{_words()}])(?![{_words()}])|(?<![{_words()}])(?=[{_words()}]))"
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            kind = classes.get(pattern[i])
            out.append(bound if pattern[i] == "b" else "\\" + pattern[i] if kind is None else kind if inside else f"[{kind}]")
        elif inside or c == "[":
            inside = c != "]"
            out.append(c)
        elif c == ".":
            out.append(f"[^{ends}]")
        elif c == "$":
            out.append(rf"(?=(?:\r\n|[{ends}])?\Z)")
        elif pattern.startswith("(?i:", i):
            out.append("(?ai:")
            i += 3
        else:
            out.append(c)
        i += 1
    return re.compile("".join(out), re.ASCII if plain else 0)


@cache
def _patterns(plain: bool) -> dict:
    """By the part of a text: number of the fact, words, value, pattern."""
    codes, out = {f: k for k, f in enumerate(fact_names())}, {}
    for f in used_facts():
        out.setdefault(f["part"], []).append((codes[f["name"]], {*f["words"]}, f["value"], java_pattern(f["pattern"], plain)))
    return out


_WORD, _LEAD = re.compile("[a-z0-9_]+"), rf"^(?:{ANNOTATION}\s*)*"
_NAME = object()  # stands for the member's name
_known = ({}, {}, {})  # bodies, heads and heads of fields


def facts_in(part: str, text: str) -> list[tuple]:
    """(number, value) of the facts that a text of a part holds."""
    words, out = {"*", *_WORD.findall(text.lower())}, []
    for code, asked, value, pattern in _patterns(text.isascii()).get(part, ()):
        if not asked.isdisjoint(words):
            if value == "1":
                out += [(code, v) for v in dict.fromkeys(pattern.findall(text))]
            elif pattern.search(text):
                out.append((code, _NAME if value == "name" else None))
    return out


def facts_of_head(code: str, field: bool) -> list[tuple]:
    """(number, value) of the facts that the code of a head holds, as a head and as a signature; as texts() parts them."""
    like = lambda pattern: java_pattern(pattern, code.isascii())
    head = like(r"[{;]\s*$").sub("", like(r"\s+").sub(" ", code).strip(" ")).strip(" ")
    plain = head
    if field:
        lead = like(_LEAD).match(head).group()
        plain = like("=.*$").sub("", head[len(lead) :])
        head = lead + plain
    return facts_in("head", head) + facts_in("signature", like(r"\s+").sub(" ", like(ANNOTATION).sub(" ", plain).strip(" ")))


def facts_of(line, code: str, part: str, field: bool, name: str | None) -> list[tuple]:
    """(line, number, value) of the facts of a piece of code; those of short ones are kept by the worker for the next of the same text."""
    known = _known[0 if part == "body" else 2 if field else 1]
    found = known.get(code)
    if found is None:
        found = keep(known, code, facts_in("body", code) if part == "body" else facts_of_head(code, field))
    return [(line, fact, name if value is _NAME else value) for fact, value in found] if found else found


def scoped_facts(lines: DataFrame) -> DataFrame:
    """repo, path, member, class_at, facts (line, fact's number, value) of every member of Java files in lines (repo, path, line, text), and of every path, as member null."""
    kinds = {f.name: f for f in lines.schema}
    fact = StructType([StructField("line", kinds["line"].dataType), StructField("fact", IntegerType()), StructField("value", StringType())])
    schema = StructType([kinds["repo"], kinds["path"], StructField("member", IntegerType()), StructField("class_at", IntegerType()), StructField("facts", ArrayType(fact))])

    def scan(batches):
        kind = {c: to_arrow_type(kinds[c].dataType) for c in ("repo", "path", "line")}
        rows, ends, at, codes, found, here, open_ = [], [0], [], [], [], None, []

        def add(place, member, class_at, facts):
            rows.append((*place, member, class_at))
            for line, code, value in facts:
                at.append(line)
                codes.append(code)
                found.append(value)
            ends.append(len(at))

        def batch():
            facts = pa.StructArray.from_arrays([pa.array(at, kind["line"]), pa.array(codes, pa.int32()), pa.array(found, pa.string())], ["line", "fact", "value"])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (kind["repo"], kind["path"], pa.int32(), pa.int32()))]
            out = pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), facts)], ["repo", "path", "member", "class_at", "facts"])
            for x in (rows, at, codes, found):
                x.clear()
            ends[:] = [0]
            return out

        for place, pieces in scanned(batches, ("member", "body")):
            if place != here:
                here, open_ = place, []
                if facts := [(1, code, value) for code, value in facts_in("path", place[1])]:
                    add(place, None, None, facts)
            for line, code, part, what, name, _, owner_at, member, _ in pieces:
                own = facts_of(line, code, part, what == "field", name)
                if part == "body":  # the member's own row comes when it ends
                    if own:
                        open_ += own
                    continue
                if open_ and what != "class":
                    own, open_ = own + open_, []
                if own:
                    add(place, member, member if what == "class" else owner_at, own)
            if len(at) >= 8192:
                yield batch()
        if rows:
            yield batch()

    is_java = F.endswith(F.col("path").cast("string"), F.lit(".java"))
    java = by_file(lines.where(is_java)).mapInArrow(scan, schema)
    return java.unionByName(grouped(member_facts(path_texts(lines.where(~is_java), lines.schema["line"].dataType)).where("fact is not null")).select(java.columns))


def member_facts(found: DataFrame) -> DataFrame:
    """repo, path, line, member, class_at, fact, value of every fact in texts() that a rule names; the same one can come several times."""
    kept = used_facts()
    rows = [(w, k, f["name"], f["part"]) for k, f in enumerate(kept) for w in f["words"]]
    table = found.sparkSession.createDataFrame(rows, "word string, at int, fact string, part string")
    words = F.array_append(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), 1)), F.lit("*"))
    met = found.withColumn("word", F.explode(words)).join(F.broadcast(table), ["word", "part"])
    none = F.lit(None).cast("array<string>")

    def values(f: dict) -> Column:
        if f["value"] == "1":
            return F.array_distinct(F.regexp_extract_all("text", F.lit(f["pattern"]), F.lit(1)))
        return F.when(F.rlike("text", F.lit(f["pattern"])), F.array("name") if f["value"] == "name" else F.array(F.lit(None).cast("string"))).otherwise(none)

    met = met.select("repo", "path", "line", "member", "class_at", "fact", chosen(F.col("at"), list(map(values, kept))).alias("values"))
    return met.select("repo", "path", "line", "member", "class_at", "fact", F.explode("values").alias("value"))


def _key() -> list[Column]:
    """Where a fact counts for a rule: its member, class, file or repo, and its value where the rule goes by it."""
    scope = F.col("scope")
    path = F.when(scope != "repo", F.col("path").cast("string"))
    at = F.when(scope == "member", F.col("member")).when(scope == "class", F.col("class_at")).otherwise(0)
    return [F.coalesce(path, F.lit("")).alias("_path"), at.alias("_at"), F.when(F.col("by_value"), F.col("value")).otherwise("").alias("_value")]


def satisfied(found: DataFrame, asked: list[dict], each: bool = False) -> DataFrame:
    """The rules asked for that hold over facts: place and value of the first fact that they name, rule_id, severity, category. One row for each group of facts
    that meets, or for each of the first facts in it. An annotation of a class keeps rules back in all members of the class."""
    rule = lambda n, r: (n, r["scope"], r["by_value"], (1 << len(r["needs"])) - 1, r["least"])
    needs = [(*rule(n, r), f, 1 << k, k == 0) for n, r in enumerate(asked) for k, f in enumerate(r["needs"])]
    none = [(*rule(n, r), f, 0, False) for n, r in enumerate(asked) for f in r["none"]]  # bit 0: keeps the rule back
    spark, names = found.sparkSession, ["repo", "_path", "_at", "_value", "rule"]
    table = spark.createDataFrame(needs + none, "rule int, scope string, by_value boolean, bits int, least int, fact string, bit int, first boolean")
    told = spark.createDataFrame([(n, r["rule_id"], r["severity"], r["category"]) for n, r in enumerate(asked)], "rule int, rule_id string, severity string, category string")
    met = found.join(F.broadcast(table), "fact")
    keyed = met.select("*", *_key(), F.when(F.col("scope") == "member", F.coalesce("class_at", F.lit(-1))).alias("_class")).where("_value is not null and _at is not null")
    far = (F.col("scope") == "repo") | (F.col("_path") == "")  # elsewhere the key has the path, and the value of rules that go by it
    place = F.struct(F.when(far, F.col("path")).alias("path"), "line", "member", "class_at", F.when(~F.col("by_value"), F.col("value")).alias("value"))
    place = F.min(F.when(F.col("first"), place)).alias("place")
    held = keyed.groupBy(*names, "_class", "bits", "least", "scope", "by_value").agg(F.bit_or("bit").alias("seen"), F.bool_or(F.col("bit") == 0).alias("guarded"), F.count_if("first").alias("n"), place)
    held = held.where("seen = bits and not guarded and n >= least")
    annotations = [f["name"] for f in facts() if f["part"] == "head"]
    outer = keyed.where("bit = 0 and scope = 'member' and member = class_at").where(F.col("fact").isin(annotations)).select("repo", "_path", F.col("class_at").alias("_class"), "_value", "rule").distinct()
    left = held.join(outer, ["repo", "_path", "_class", "_value", "rule"], "left_anti")
    if each:
        return keyed.where("first").join(left.select(*names), names).join(F.broadcast(told), "rule").select("repo", "path", "line", "member", "class_at", "value", "rule_id", "severity", "category")
    path, value = F.when(far, F.col("place.path")).otherwise(F.col("_path").cast(found.schema["path"].dataType)).alias("path"), F.when(F.col("by_value"), F.col("_value")).otherwise(F.col("place.value")).alias("value")
    return left.join(F.broadcast(told), "rule").select("repo", path, "place.line", "place.member", "place.class_at", value, "rule_id", "severity", "category")


def grouped(found: DataFrame) -> DataFrame:
    """Facts of member_facts() as scoped_facts() gives them, a row a member."""
    numbers = F.create_map(*[x for k, f in enumerate(fact_names()) for x in (F.lit(f), F.lit(k))])
    return found.groupBy("repo", "path", "member", "class_at").agg(F.collect_list(F.struct("line", numbers[F.col("fact")].alias("fact"), "value")).alias("facts"))


def within_members(asked: list[dict]) -> list[dict]:
    """Those rules that the facts found in a member alone decide."""
    more = {r["rule_id"] for r in derived()}
    return [r for r in asked if r["scope"] == "member" and not r["by_value"] and r["least"] == 1 and more.isdisjoint(r["needs"] + r["none"])]


def _spots(asked: list[dict]) -> dict[str, tuple[int, int]]:
    """Word and bit of each fact that the rules name."""
    return {f: divmod(k, 62) for k, f in enumerate(sorted({f for r in asked for f in r["needs"] + r["none"]}))}


def with_bits(found: DataFrame, asked: list[dict]) -> DataFrame:
    """Rows of scoped_facts() with those of their facts that the rules name, as bits of a long or more."""
    spots, names = _spots(asked), fact_names()

    def bits(w: int) -> Column:
        table = F.array(*[F.lit(1 << spots[f][1] if f in spots and spots[f][0] == w else 0).cast("long") for f in names])
        return F.aggregate("facts", F.lit(0).cast("long"), lambda held, x: held.bitwiseOR(table[x["fact"]]))

    return found.select("*", *[bits(w).alias(f"_bits{w}") for w in sorted({w for w, _ in spots.values()})])


def satisfied_within(found: DataFrame, asked: list[dict], spots: dict, each: bool = False) -> DataFrame:
    """As satisfied(), for rules of within_members() over with_bits()."""
    number, words = {f: k for k, f in enumerate(fact_names())}, sorted({w for w, _ in spots.values()})
    annotations = {f["name"] for f in facts() if f["part"] == "head"}

    def seen(of: list[str], w: int) -> tuple[Column, Column]:
        mask = F.lit(sum(1 << spots[f][1] for f in {*of} if spots[f][0] == w)).cast("long")
        return F.col(f"_bits{w}").bitwiseAND(mask), mask

    def holds(r: dict) -> Column:
        out = F.lit(True)
        for w in words:
            (needed, all_), (barred, _) = seen(r["needs"], w), seen(r["none"], w)
            out = out & (needed == all_) & (barred == 0)
        return out

    def kept_back(r: dict) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | (seen([f for f in r["none"] if f in annotations], w)[0] != 0)
        return out

    def numbers(rows: DataFrame, test) -> DataFrame:
        """rows once for each rule that the test holds for."""
        tests = [test(r) for r in asked]
        return rows.where(reduce(or_, tests)).withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in enumerate(tests)]))))

    of_rule = lambda values: F.array(*map(F.lit, values))[F.col("rule")]
    place = [F.coalesce(F.col("path").cast("string"), F.lit("")).alias("_path"), F.coalesce("class_at", F.lit(-1)).alias("_class")]
    held = found.where("member is not null")
    outer = numbers(held.where("member = class_at"), kept_back).select("repo", *place, "rule").distinct()
    held = numbers(held, holds).select("repo", "path", "member", "class_at", "facts", *place, "rule").withColumn("_first", of_rule([number[r["needs"][0]] for r in asked]))
    firsts = F.filter("facts", lambda x: x["fact"] == F.col("_first"))
    held = held.withColumn("_place", F.explode(firsts) if each else F.array_min(firsts)).select("repo", "path", "_path", "_class", "member", "class_at", "rule", "_place.line", "_place.value")
    told = [of_rule([r[c] for r in asked]).alias(c) for c in ("rule_id", "severity", "category")]
    return held.join(outer, ["repo", "_path", "_class", "rule"], "left_anti").select("repo", "path", "line", "member", "class_at", "value", *told)


def evaluate(found: DataFrame) -> DataFrame:
    """Findings (repo, path, line, rule_id, severity, category, value) of all rules over member_facts()."""
    return evaluate_members(grouped(found))


def evaluate_members(found: DataFrame) -> DataFrame:
    """Findings of all rules over scoped_facts(), which are written once, and those that meet across members once more, as they are read several times."""
    all_ = rules() + derived()
    inside = within_members(all_)
    spots, found = _spots(inside), cut(with_bits(found, inside))
    names, apart = fact_names(), {f for r in all_ if r not in inside for f in r["needs"] + r["none"]}
    rows = found.select("repo", "path", "member", "class_at", F.explode("facts").alias("x")).where(F.col("x.fact").isin([k for k, f in enumerate(names) if f in apart]))
    rows = cut(rows.select("repo", "path", "x.line", "member", "class_at", F.array(*map(F.lit, names))[F.col("x.fact")].alias("fact"), "x.value"))
    counted = F.col("fact").isin(sorted({r["needs"][0] for r in all_ if r["least"] > 1}))
    rows = rows.where(~counted).unionByName(rows.where(counted).distinct())  # bits and places do not mind repeats, counts do
    more = satisfied(rows, [r for r in derived() if r not in inside], each=True)
    more = more.unionByName(satisfied_within(found, [r for r in derived() if r in inside], spots, each=True).where("repo is not null").select(more.columns))
    rows = rows.unionByName(more.select("repo", "path", "line", "member", "class_at", F.col("rule_id").alias("fact"), "value").select(rows.columns))
    out = satisfied(rows, [r for r in rules() if r not in inside]).select("repo", "path", "line", "rule_id", "severity", "category", "value")
    return out.unionByName(satisfied_within(found, [r for r in rules() if r in inside], spots).select(out.columns))
