"""Contracts of plans, host snapshots and bindings: JSON records read with a nested schema, all issues of a record at once, with paths.

References inside a record (duplicate ids, unknown groups, ids that depend on digests of others) are checked on its own
arrays, one row for each element; a record is never joined with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import query
from quire.sources.tables import table

# Versions and names of the contracts.
CONTRACT, PLAN, SNAPSHOT, BINDING = "integration-contract-v1", "recognition-plan-v1", "host-snapshot-v1", "recognition-binding-v1"
LOCATOR, HOST_TEXT, OFFSETS = "source-locator-v2", "host-text-v1", "utf16_code_unit"
ACTIONS = {"confirmed": "verify_host_range", "review": "preview_only", "unresolved": "skip"}
PLAN_CODE, SNAPSHOT_CODE, BINDING_CODE = "INVALID_RECOGNITION_PLAN", "INVALID_HOST_SNAPSHOT", "INVALID_RECOGNITION_BINDING"
DIGEST = "^[0-9a-f]{64}$"

_SPAN = "struct<start:bigint,end:bigint,coordinate_system:string,encoding:string>"
_DIGESTS = ("physical_raw_text_sha256", "physical_canonical_text_sha256", "raw_fragment_sha256", "canonical_fragment_sha256", "prefix_context_sha256", "suffix_context_sha256")
_LOCATOR = f"struct<physical_paragraph_index:bigint,physical_occurrence_index:bigint,physical_text_length_utf16:bigint,physical_canonical_text_length_utf16:bigint,raw_span:{_SPAN},canonical_span:{_SPAN},{','.join(f'{d}:string' for d in _DIGESTS)}>"
_BLOCK = f"struct<block_id:string,block_index:bigint,physical_group_id:string,source_locator:{_LOCATOR},segment:struct<index:bigint,count:bigint,count_total:bigint,count_located:bigint,count_confirmed:bigint>,semantic:struct<type_id:string>,text:struct<recognized_text:string,raw_fragment_text:string>>"
PLAN_SCHEMA = (
    "struct<schema_version:string,integration_contract_version:string,plan_id:string,source:struct<sha256:string,text_included:boolean,raw_text_included:boolean>,producer:struct<engine_version:string,package_version:string>,"
    f"contracts:struct<source_locator_version:string,host_text_contract_version:string,offset_encoding:string>,recognition:struct<processing_mode:string,recognition_mode:string,request_digest:string>,blocks:array<{_BLOCK}>,review_items:array<struct<block_id:string,block_index:bigint>>>"
)
SNAPSHOT_SCHEMA = "struct<schema_version:string,integration_contract_version:string,text_contract_version:string,offset_encoding:string,paragraphs:array<struct<host_paragraph_id:string,host_paragraph_index:bigint>>>"
BINDING_SCHEMA = (
    "struct<schema_version:string,integration_contract_version:string,source_sha256:string,contracts:struct<source_locator_version:string,host_text_contract_version:string,offset_encoding:string>,"
    "summary:struct<total_blocks:bigint,confirmed_blocks:bigint,review_blocks:bigint,unresolved_blocks:bigint,complete_physical_groups:bigint,incomplete_physical_groups:bigint>,"
    "physical_paragraphs:array<struct<physical_group_id:string,status:string,host_paragraph_id:string>>,"
    f"blocks:array<struct<block_id:string,physical_group_id:string,binding:struct<status:string,recommended_action:string>,host_target:struct<host_paragraph_id:string,raw_span:{_SPAN}>>>>"
)
ISSUE = "array<struct<code:string,path:string,reason:string>>"


def issue(when: Column, code: str | Column, path: Column | str, reason: str | None = None) -> Column:
    """struct(code, path, reason) where the condition holds; unknown is no issue."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(F.coalesce(when, F.lit(False)), F.struct(text(code).alias("code"), text(path).alias("path"), F.lit(reason).cast("string").alias("reason")))


def bad_digest(value: Column, required: bool = False) -> Column:
    given = F.coalesce(value, F.lit("")) != ""
    wrong = ~F.coalesce(value, F.lit("")).rlike(DIGEST)
    return wrong if required else given & wrong


def json_part(value: Column, text: bool = True) -> Column:
    """A value as it stands in a JSON array; text: quoted and escaped."""
    # Most texts need no escapes.
    quoted = F.when(value.rlike(r'["\\\x00-\x1f]'), F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")).otherwise(F.concat(F.lit('"'), value, F.lit('"'))) if text else value.cast("string")
    return F.when(value.isNull(), "null").otherwise(quoted)


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id of the parts, each as json_part: a digest of their JSON array."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256), 1, 32))


def span_issues(span: Column, path: Column, coordinate: str, code: str, most: Column | None = None, required: bool = False) -> list[Column]:
    a, b = span["start"], span["end"]
    open_ = a.isNull() | b.isNull()
    wrong = ~open_ & (a > b)
    found = [
        issue(~span["coordinate_system"].eqNullSafe(F.lit(coordinate)), code, F.concat(path, F.lit(".coordinate_system"))),
        issue(~span["encoding"].eqNullSafe(F.lit(OFFSETS)), code, F.concat(path, F.lit(".encoding"))),
        issue(open_ if required else a.isNull() != b.isNull(), code, path, "incomplete_span"),
        issue(wrong, code, path, "invalid_span"),
    ]
    return found + ([] if most is None else [issue(~open_ & ~wrong & (b > most), code, path, "span_out_of_bounds")])


def checked(records: DataFrame, schema: str, code: str, root: list[Column], lists: dict[str, tuple[Column, list[Column]]], carried: dict[str, Column], steps: dict[str, Column]) -> DataFrame:
    """(id, code, path, reason) of every issue of records (id, json), each of which is parsed once: a row for the record itself and one for each element of its lists.

    root: issues of the record r. lists: a list of r and the issues of an element, which is the column of the list's name, at place i. carried: columns
    of r that the elements need; steps: columns that follow from an element, each used more than once. A text that is no JSON object has that one issue.
    """
    spark = records.sparkSession
    known = [f.name for f in spark.createDataFrame([], f"r {schema}").schema["r"].dataType.fields]
    df = records.select("id", F.from_json("json", schema).alias("r"), F.json_object_keys("json").alias("fields"))
    of = {name: df.select(values.alias("x")).schema["x"].dataType.elementType for name, (values, _) in lists.items()}
    one = lambda i, **given: F.struct(F.lit(next(iter(given), None)).cast("string").alias("kind"), i.cast("int").alias("i"), *[given.get(name, F.lit(None).cast(kind)).alias(name) for name, kind in of.items()])
    own = F.array(one(F.lit(-1)))
    no_object = F.array(F.struct(F.lit(code).alias("code"), F.lit("$").alias("path"), F.lit("no_object").alias("reason"))).cast(ISSUE)
    unknown = F.transform(F.array_except("fields", F.array(*map(F.lit, known))), lambda f: F.struct(F.lit(code).alias("code"), F.concat(F.lit("$."), f).alias("path"), F.lit("unknown_field").alias("reason")))
    each = lambda name: lambda x, i: one(i, **{name: x})
    listed = [F.coalesce(F.transform(values, each(name)), F.slice(own, 1, 0)) for name, (values, _) in lists.items()]
    object_ = F.col("fields").isNotNull()
    df = df.select("id", *[v.alias(k) for k, v in carried.items()], F.when(object_, F.concat(unknown, F.array(*root))).otherwise(no_object).alias("root"), F.when(object_, F.concat(own, *listed)).otherwise(own).alias("elements"))
    # Of an outer explode the optimizer infers no filter on its input, which would parse the record once more.
    rows = df.select("id", *carried, "root", F.explode_outer("elements").alias("e")).select("id", *carried, "root", "e.*")
    for name, value in steps.items():
        rows = rows.withColumn(name, value)
    # A projection with a lambda is compiled in small pieces; as one piece the issues of a block are too large for the JVM to compile.
    found = F.when(F.col("kind").isNull(), F.array_compact("root"))
    for name, (_, issues) in lists.items():
        found = found.when(F.col("kind") == name, F.array(*issues))
    return rows.select("id", found.alias("found")).select("id", F.explode_outer("found").alias("x")).where(F.col("x").isNotNull()).select("id", "x.code", "x.path", "x.reason")


def versions(r: Column, schema: str, code: str, nested: bool) -> list[Column]:
    c = r["contracts"] if nested else r
    at = "$.contracts." if nested else "$."
    host = "host_text_contract_version" if nested else "text_contract_version"
    found = [
        issue(~r["schema_version"].eqNullSafe(F.lit(schema)), "UNSUPPORTED_SCHEMA_VERSION", "$.schema_version"),
        issue(~r["integration_contract_version"].eqNullSafe(F.lit(CONTRACT)), "UNSUPPORTED_INTEGRATION_CONTRACT", "$.integration_contract_version"),
        issue(~c[host].eqNullSafe(F.lit(HOST_TEXT)), "UNSUPPORTED_HOST_TEXT_CONTRACT", at + host), issue(~c["offset_encoding"].eqNullSafe(F.lit(OFFSETS)), "UNSUPPORTED_OFFSET_ENCODING", at + "offset_encoding"),
    ]
    return found + ([issue(~c["source_locator_version"].eqNullSafe(F.lit(LOCATOR)), "UNSUPPORTED_SCHEMA_VERSION", at + "source_locator_version")] if nested else [])


def plan_issues(records: DataFrame) -> DataFrame:
    """(id, code, path, reason) of every issue of recognition plans (id, json)."""
    r = F.col("r")
    s, n = json_part, lambda x: json_part(x, False)
    own = stable_id("plan", *[s(x) for x in (r["source"]["sha256"], r["integration_contract_version"], r["schema_version"], r["producer"]["engine_version"], r["producer"]["package_version"], r["contracts"]["source_locator_version"], r["contracts"]["host_text_contract_version"], F.lit(OFFSETS), r["recognition"]["processing_mode"], r["recognition"]["recognition_mode"], F.coalesce(r["recognition"]["request_digest"], F.lit("")))])
    root = [*versions(r, PLAN, PLAN_CODE, True), issue(bad_digest(r["source"]["sha256"], True), PLAN_CODE, "$.source.sha256", "invalid_sha256"), issue(~r["plan_id"].eqNullSafe(own), PLAN_CODE, "$.plan_id", "stable_id_mismatch")]

    carried = {"plan_id": r["plan_id"], "source": r["source"], "ids": F.transform(r["blocks"], lambda b: b["block_id"]), "indexes": F.transform(r["blocks"], lambda b: b["block_index"])}
    b, i = F.col("b"), F.col("i")
    loc, seg, path = b["source_locator"], b["segment"], F.concat(F.lit("$.blocks["), F.col("i").cast("string"), F.lit("]"))
    group = stable_id("pg", s(F.col("plan_id")), n(loc["physical_paragraph_index"]), n(loc["physical_occurrence_index"]), s(loc["physical_raw_text_sha256"]), F.when(loc["physical_paragraph_index"].isNull(), n(b["block_index"])))
    block = stable_id("blk", s(F.col("plan_id")), s(F.col("group")), n(seg["index"]), s(loc["raw_fragment_sha256"]), s(loc["canonical_fragment_sha256"]), s(b["semantic"]["type_id"]))
    at = lambda x: F.concat(path, F.lit(x))
    found = [
        issue(F.array_position("ids", b["block_id"]) <= i, PLAN_CODE, at(".block_id"), "duplicate_id"), issue(F.array_position("indexes", b["block_index"]) <= i, PLAN_CODE, at(".block_index"), "duplicate_index"),
        issue(~b["physical_group_id"].eqNullSafe(F.col("group")), PLAN_CODE, at(".physical_group_id"), "stable_id_mismatch"), issue(~b["block_id"].eqNullSafe(F.col("block")), PLAN_CODE, at(".block_id"), "stable_id_mismatch"),
        *span_issues(loc["raw_span"], at(".source_locator.raw_span"), "source_raw_text", PLAN_CODE, loc["physical_text_length_utf16"]),
        *span_issues(loc["canonical_span"], at(".source_locator.canonical_span"), "source_canonical_text", PLAN_CODE, loc["physical_canonical_text_length_utf16"]),
        *[issue(bad_digest(loc[d]), PLAN_CODE, at(f".source_locator.{d}"), "invalid_sha256") for d in _DIGESTS],
        issue((seg["count"] > 0) & (seg["index"] >= seg["count"]), PLAN_CODE, at(".segment.index")), issue(seg["count"] > seg["count_total"], PLAN_CODE, at(".segment.count")),
        issue(seg["count_located"] > seg["count_total"], PLAN_CODE, at(".segment.count_located")), issue(seg["count_confirmed"] > seg["count_located"], PLAN_CODE, at(".segment.count_confirmed")),
        issue(~F.col("source")["text_included"] & b["text"]["recognized_text"].isNotNull(), "PRIVACY_POLICY_VIOLATION", at(".text.recognized_text")),
        issue(~F.col("source")["raw_text_included"] & b["text"]["raw_fragment_text"].isNotNull(), "PRIVACY_POLICY_VIOLATION", at(".text.raw_fragment_text")),
    ]
    v, named = F.col("v"), F.coalesce(F.col("v.block_id"), F.lit("")) != ""
    review = lambda x: F.concat(F.lit("$.review_items["), F.col("i").cast("string"), F.lit("]" + x))
    asked = [issue(named & ~F.array_contains("ids", v["block_id"]), PLAN_CODE, review(".block_id"), "unknown_block_id"), issue(~named & ~F.coalesce(F.array_contains("indexes", v["block_index"]), F.lit(False)), PLAN_CODE, review(".block_index"), "unknown_block_index")]
    of_block = lambda x: F.when(F.col("kind") == "b", x)
    return checked(records, PLAN_SCHEMA, PLAN_CODE, root, {"b": (r["blocks"], found), "v": (r["review_items"], asked)}, carried, {"group": of_block(group), "block": of_block(block)})


def snapshot_issues(records: DataFrame) -> DataFrame:
    """(id, code, path, reason) of every issue of host snapshots (id, json)."""
    r = F.col("r")
    part = lambda n: F.transform(r["paragraphs"], lambda p: p[n])
    at = lambda x: F.concat(F.lit("$.paragraphs["), F.col("i").cast("string"), F.lit("]" + x))
    found = [issue(F.array_position("ids", F.col("p.host_paragraph_id")) <= F.col("i"), SNAPSHOT_CODE, at(".host_paragraph_id"), "duplicate_id"), issue(F.array_position("indexes", F.col("p.host_paragraph_index")) <= F.col("i"), SNAPSHOT_CODE, at(".host_paragraph_index"), "duplicate_index")]
    return checked(records, SNAPSHOT_SCHEMA, SNAPSHOT_CODE, versions(r, SNAPSHOT, SNAPSHOT_CODE, False), {"p": (r["paragraphs"], found)}, {"ids": part("host_paragraph_id"), "indexes": part("host_paragraph_index")}, {})


def binding_issues(records: DataFrame) -> DataFrame:
    """(id, code, path, reason) of every issue of bindings (id, json): groups, actions, targets and the counts of the summary."""
    r = F.col("r")
    groups, blocks = r["physical_paragraphs"], r["blocks"]
    count = lambda status: F.size(F.filter(blocks, lambda b: b["binding"]["status"] == status))
    settled = F.array(F.lit("matched_unique"), F.lit("matched_review"))

    def complete(g: Column) -> Column:
        own = F.filter(blocks, lambda b: b["physical_group_id"] == g["physical_group_id"])
        return F.array_contains(settled, g["status"]) & (F.size(own) > 0) & F.forall(own, lambda b: F.coalesce(b["binding"]["status"].isin("confirmed", "review"), F.lit(False)))

    whole = F.size(F.filter(groups, complete))
    counted = {"total_blocks": F.size(blocks), **{f"{s}_blocks": count(s) for s in ACTIONS}, "complete_physical_groups": whole, "incomplete_physical_groups": F.size(groups) - whole}
    root = [*versions(r, BINDING, BINDING_CODE, True), issue(bad_digest(r["source_sha256"], True), BINDING_CODE, "$.source_sha256", "invalid_sha256"), *[issue(~r["summary"][k].eqNullSafe(v.cast("bigint")), BINDING_CODE, f"$.summary.{k}") for k, v in counted.items()]]
    part = F.transform(groups, lambda g: g["physical_group_id"])
    at = lambda where: lambda x: F.concat(F.lit(f"$.{where}["), F.col("i").cast("string"), F.lit("]" + x))
    here, g = at("physical_paragraphs"), F.col("g")
    lacks = lambda x: F.coalesce(x, F.lit("")) == ""
    of_groups = [issue((g["physical_group_id"] != "") & (F.array_position("groups", g["physical_group_id"]) <= F.col("i")), BINDING_CODE, here(".physical_group_id"), "duplicate_id"), issue(F.array_contains(settled, g["status"]) & lacks(g["host_paragraph_id"]), BINDING_CODE, here(".host_paragraph_id"), "missing_host_reference")]
    carried = {"groups": part, "all": groups, "ids": F.transform(blocks, lambda b: b["block_id"])}
    # Of groups with one id the last counts.
    host = F.element_at(F.concat(F.array(F.lit(None).cast("struct<physical_group_id:string,status:string,host_paragraph_id:string>")), F.filter("all", lambda x: x["physical_group_id"] == F.col("b.physical_group_id"))), -1)
    b, status, target, there = F.col("b"), F.col("b.binding.status"), F.col("b.host_target"), at("blocks")
    expected = F.when(status == "confirmed", ACTIONS["confirmed"]).when(status == "review", ACTIONS["review"]).when(status == "unresolved", ACTIONS["unresolved"])
    confirmed, unresolved = status == "confirmed", status == "unresolved"
    spans = span_issues(target["raw_span"], there(".host_target.raw_span"), "host_snapshot_raw_text", BINDING_CODE)
    needed = confirmed | (status == "review")
    of_blocks = [
        issue(F.array_position("ids", b["block_id"]) <= F.col("i"), BINDING_CODE, there(".block_id"), "duplicate_id"),
        issue((b["physical_group_id"] != "") & ~status.eqNullSafe(F.lit("unresolved")) & ~F.array_contains("groups", b["physical_group_id"]), BINDING_CODE, there(".physical_group_id"), "unknown_physical_group"),
        issue(~b["binding"]["recommended_action"].eqNullSafe(expected), BINDING_CODE, there(".binding.recommended_action")), issue(confirmed & lacks(target["host_paragraph_id"]), BINDING_CODE, there(".host_target.host_paragraph_id")),
        issue(confirmed & F.col("host").isNotNull() & ~target["host_paragraph_id"].eqNullSafe(F.col("host.host_paragraph_id")), BINDING_CODE, there(".host_target.host_paragraph_id"), "physical_group_host_mismatch"),
        issue(unresolved & (target["host_paragraph_id"].isNotNull() | target["raw_span"]["start"].isNotNull() | target["raw_span"]["end"].isNotNull()), BINDING_CODE, there(".host_target"), "unresolved_executable_target"),
        *[F.when(status.isin(*ACTIONS), x) for x in spans], issue(needed & target["raw_span"]["start"].isNull() & target["raw_span"]["end"].isNull(), BINDING_CODE, there(".host_target.raw_span"), "incomplete_span"),
    ]
    return checked(records, BINDING_SCHEMA, BINDING_CODE, root, {"g": (groups, of_groups), "b": (blocks, of_blocks)}, carried, {"host": F.when(F.col("kind") == "b", host)})


# Derived records: an order is a record, its lines are the blocks; the keys decide what is wrong.
_FACTS = "select l_orderkey as d, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as i, cast(min(l_quantity) as int) as q, cast(min(l_suppkey) as int) as s from lineitem group by l_orderkey, l_linenumber"
_SHA = "sha256({})"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FACTS.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, json) of derived plans."""
    e, s, n = F.expr, json_part, lambda x: json_part(x, False)
    f = _facts(spark, sf_dir).withColumns({"sha": e("case when d % 26 = 0 then 'x' else sha2(concat('doc', d), 256) end"), "contract": e(f"case when d % 9 = 0 then 'v0' else '{CONTRACT}' end")})
    right = stable_id("plan", *[s(x) for x in (F.col("sha"), F.col("contract"), F.lit(PLAN), F.lit("1.0"), F.lit("2.9"), F.lit(LOCATOR), F.lit(HOST_TEXT), F.lit(OFFSETS), F.lit("normalize"), F.lit("legacy"), F.lit(""))])
    f = f.withColumn("plan_id", F.when(F.col("d") % 21 == 0, "plan_x").otherwise(right)).withColumns({"para": e("case when s % 61 = 0 then null else i div 2 end"), "raw": e("sha2(concat('raw', d, '-', i div 2), 256)"), "part": e("case when q % 19 = 0 then 'xyz' else sha2(concat('part', d, '-', i), 256) end"), "index": e("case when s % 23 = 0 then 0 else i end")})
    f = f.withColumn("right_group", stable_id("pg", s(F.col("plan_id")), n(F.col("para")), F.lit("0"), s(F.col("raw")), F.when(F.col("para").isNull(), n(F.col("index")))))
    f = f.withColumn("right_block", stable_id("blk", s(F.col("plan_id")), s(F.col("right_group")), n(e("i % 2")), s(F.col("part")), s(F.col("part")), s(F.lit("body"))))
    span = lambda a, b, kind, code: F.struct(e(f"cast({a} as bigint)").alias("start"), e(f"cast({b} as bigint)").alias("end"), e(kind).alias("coordinate_system"), e(code).alias("encoding"))
    locator = F.struct(
        F.col("para").cast("bigint").alias("physical_paragraph_index"), F.lit(0).cast("bigint").alias("physical_occurrence_index"), e("cast(case when s % 13 = 0 then q - 1 else q + 1 end as bigint)").alias("physical_text_length_utf16"),
        span("case when s % 31 = 0 then q + 5 else 0 end", "case when s % 37 = 0 then null else q end", "case when s % 43 = 0 then 'x' else 'source_raw_text' end", f"case when s % 47 = 0 then 'utf8' else '{OFFSETS}' end").alias("raw_span"),
        span("0", "q", "'source_canonical_text'", f"'{OFFSETS}'").alias("canonical_span"), F.col("raw").alias("physical_raw_text_sha256"), F.col("part").alias("raw_fragment_sha256"), F.col("part").alias("canonical_fragment_sha256"),
    )
    seg = F.struct(*[e(f"cast({x} as bigint)").alias(k) for k, x in (("index", "i % 2"), ("count", "case when s % 11 = 0 then 1 else 2 end"), ("count_total", "case when s % 53 = 0 then 1 else 2 end"), ("count_located", "2"), ("count_confirmed", "case when s % 59 = 0 then 3 else 2 end"))])
    block = F.struct(
        F.col("i"), e("case when q % 17 = 0 then 'blk_dup' else right_block end").alias("block_id"), F.col("index").alias("block_index"), e("case when s % 29 = 0 then 'pg_x' else right_group end").alias("physical_group_id"), locator.alias("source_locator"), seg.alias("segment"),
        F.struct(F.lit("body").alias("type_id")).alias("semantic"), F.struct(e("case when s % 7 = 0 then 't' end").alias("recognized_text"), e("case when s % 5 = 0 then 't' end").alias("raw_fragment_text")).alias("text"),
    )
    item = F.when(F.col("q") % 10 == 0, F.struct(F.col("i"), e("case when s % 3 = 0 then 'blk_none' when s % 3 = 1 then case when q % 17 = 0 then 'blk_dup' else right_block end end").alias("block_id"), e("cast(case when s % 2 = 0 then 99 else index end as bigint)").alias("block_index")))
    g = f.groupBy("d", "sha", "contract", "plan_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"), F.sort_array(F.collect_list(item)).alias("review_items"))
    without = lambda c: F.transform(c, lambda x: x.dropFields("i"))
    record = F.struct(
        F.lit(PLAN).alias("schema_version"), F.col("contract").alias("integration_contract_version"), F.col("plan_id"), F.struct(F.col("sha").alias("sha256"), (F.col("d") % 5 != 0).alias("text_included"), (F.col("d") % 4 != 0).alias("raw_text_included")).alias("source"),
        F.struct(F.lit("1.0").alias("engine_version"), F.lit("2.9").alias("package_version")).alias("producer"), F.struct(F.lit(LOCATOR).alias("source_locator_version"), F.lit(HOST_TEXT).alias("host_text_contract_version"), e(f"case when d % 14 = 0 then 'utf8' else '{OFFSETS}' end").alias("offset_encoding")).alias("contracts"),
        F.struct(F.lit("normalize").alias("processing_mode"), F.lit("legacy").alias("recognition_mode"), F.lit("").alias("request_digest")).alias("recognition"), without("blocks").alias("blocks"), without("review_items").alias("review_items"), F.when(F.col("d") % 33 == 0, "x").alias("extra"),
    )
    return g.select(F.col("d").alias("id"), F.when(F.col("d") % 97 == 0, "[1").otherwise(F.to_json(record)).alias("json"))


def _issue_sql(when: str, path: str, reason: str | None = None, code: str = PLAN_CODE) -> str:
    return f"select d as id, '{code}' as code, {path} as path, {f''''{reason}' ''' if reason else 'null::varchar'} as reason from x where {when}"


_AT = "'$.blocks[' || i || ']"
_LOC = _AT + ".source_locator."
_Q = chr(34)
_LIST = lambda *parts: "'[' || " + " || ',' || ".join(parts) + " || ']'"
_STR = lambda x: f"'{_Q}' || {x} || '{_Q}'"
PLAN_SQL = f"""f as ({_FACTS}), p as (select *, case when d % 26 = 0 then 'x' else sha256('doc' || d) end as sha, case when d % 9 = 0 then 'v0' else '{CONTRACT}' end as contract from f where d % 97 <> 0),
p2 as (select *, case when d % 21 = 0 then 'plan_x' else 'plan_' || left(sha256({_LIST(_STR('sha'), _STR('contract'), *[_STR(f"'{v}'") for v in (PLAN, '1.0', '2.9', LOCATOR, HOST_TEXT, OFFSETS, 'normalize', 'legacy', '')])}), 32) end as plan_id, case when s % 61 = 0 then null else i // 2 end as para,
  sha256('raw' || d || '-' || i // 2) as raw, case when q % 19 = 0 then 'xyz' else sha256('part' || d || '-' || i) end as part, case when s % 23 = 0 then 0 else i end as idx from p),
p3 as (select *, 'pg_' || left(sha256('[' || {_STR('plan_id')} || ',' || coalesce(para::varchar, 'null') || ',0,' || {_STR('raw')} || case when para is null then ',' || idx else '' end || ']'), 32) as grp from p2),
p4 as (select *, 'blk_' || left(sha256({_LIST(_STR('plan_id'), _STR('grp'), 'i % 2', _STR('part'), _STR('part'), _STR("'body'"))}), 32) as blk from p3),
x as (select *, case when q % 17 = 0 then 'blk_dup' else blk end as block_id, row_number() over (partition by d, case when q % 17 = 0 then 'blk_dup' else blk end order by i) as nth, row_number() over (partition by d, idx order by i) as nth_index, list(case when q % 17 = 0 then 'blk_dup' else blk end) over (partition by d) as ids, list(idx) over (partition by d) as indexes,
  count(*) filter (where q % 10 = 0) over (partition by d order by i) - 1 as v from p4),
r as (select distinct d, sha, contract from x)"""


@query(f"""with {PLAN_SQL} select distinct l_orderkey as id, '{PLAN_CODE}' as code, '$' as path, 'no_object' as reason from lineitem where l_orderkey % 97 = 0
union all select d, '{PLAN_CODE}', '$.extra', 'unknown_field' from r where d % 33 = 0 union all select d, 'UNSUPPORTED_INTEGRATION_CONTRACT', '$.integration_contract_version', null from r where d % 9 = 0 union all select d, 'UNSUPPORTED_OFFSET_ENCODING', '$.contracts.offset_encoding', null from r where d % 14 = 0
union all select d, '{PLAN_CODE}', '$.source.sha256', 'invalid_sha256' from r where d % 26 = 0 union all select d, '{PLAN_CODE}', '$.plan_id', 'stable_id_mismatch' from r where d % 21 = 0
union all {_issue_sql('nth > 1', _AT + ".block_id'", 'duplicate_id')} union all {_issue_sql('nth_index > 1', _AT + ".block_index'", 'duplicate_index')} union all {_issue_sql('s % 29 = 0', _AT + ".physical_group_id'", 'stable_id_mismatch')} union all {_issue_sql('q % 17 = 0', _AT + ".block_id'", 'stable_id_mismatch')}
union all {_issue_sql('s % 43 = 0', _LOC + "raw_span.coordinate_system'")} union all {_issue_sql('s % 47 = 0', _LOC + "raw_span.encoding'")} union all {_issue_sql('s % 37 = 0', _LOC + "raw_span'", 'incomplete_span')} union all {_issue_sql('s % 31 = 0 and s % 37 <> 0', _LOC + "raw_span'", 'invalid_span')}
union all {_issue_sql('s % 13 = 0 and s % 37 <> 0 and s % 31 <> 0', _LOC + "raw_span'", 'span_out_of_bounds')} union all {_issue_sql('q % 19 = 0', _LOC + "raw_fragment_sha256'", 'invalid_sha256')} union all {_issue_sql('q % 19 = 0', _LOC + "canonical_fragment_sha256'", 'invalid_sha256')}
union all {_issue_sql('s % 11 = 0 and i % 2 = 1', _AT + ".segment.index'")} union all {_issue_sql('s % 53 = 0 and s % 11 <> 0', _AT + ".segment.count'")} union all {_issue_sql('s % 53 = 0', _AT + ".segment.count_located'")} union all {_issue_sql('s % 59 = 0', _AT + ".segment.count_confirmed'")}
union all {_issue_sql('d % 5 = 0 and s % 7 = 0', _AT + ".text.recognized_text'", None, 'PRIVACY_POLICY_VIOLATION')} union all {_issue_sql('d % 4 = 0 and s % 5 = 0', _AT + ".text.raw_fragment_text'", None, 'PRIVACY_POLICY_VIOLATION')}
union all {_issue_sql('q % 10 = 0 and s % 3 = 0', "'$.review_items[' || v || '].block_id'", 'unknown_block_id')} union all {_issue_sql('q % 10 = 0 and s % 3 = 2 and not list_contains(indexes, case when s % 2 = 0 then 99 else idx end)', "'$.review_items[' || v || '].block_index'", 'unknown_block_index')}""")
def plan_contract_issues(spark, sf_dir):
    """Every issue of derived recognition plans: versions, digests, ids that follow from others, duplicates, spans, segments, privacy, review items."""
    return plan_issues(plans(spark, sf_dir))


@query(f"""with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn, role) - 1 as i from conversations), k as (select *, case when conv_id % 3 = 0 then turn // 2 else turn end as id, case when conv_id % 4 = 0 then turn % 3 else i end as idx from c),
n as (select *, row_number() over (partition by conv_id, id order by i) as a, row_number() over (partition by conv_id, idx order by i) as b from k)
select conv_id as id, '{SNAPSHOT_CODE}' as code, '$.paragraphs[' || i || '].host_paragraph_id' as path, 'duplicate_id' as reason from n where a > 1 union all select conv_id, '{SNAPSHOT_CODE}', '$.paragraphs[' || i || '].host_paragraph_index', 'duplicate_index' from n where b > 1
union all select distinct conv_id, 'UNSUPPORTED_HOST_TEXT_CONTRACT', '$.text_contract_version', null from c where conv_id % 5 = 0 union all select distinct conv_id, 'UNSUPPORTED_SCHEMA_VERSION', '$.schema_version', null from c where conv_id % 7 = 0""")
def snapshot_contract_issues(spark, sf_dir):
    """Every issue of derived host snapshots: versions, duplicate ids and indexes."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    one = lambda x, i: F.struct(F.concat(F.lit("p"), F.when(F.col("conv_id") % 3 == 0, F.floor(x["turn"] / 2)).otherwise(x["turn"]).cast("string")).alias("host_paragraph_id"), F.when(F.col("conv_id") % 4 == 0, x["turn"] % 3).otherwise(i).cast("bigint").alias("host_paragraph_index"))
    record = F.struct(F.when(F.col("conv_id") % 7 == 0, "v0").otherwise(SNAPSHOT).alias("schema_version"), F.lit(CONTRACT).alias("integration_contract_version"), F.when(F.col("conv_id") % 5 == 0, "v0").otherwise(HOST_TEXT).alias("text_contract_version"), F.lit(OFFSETS).alias("offset_encoding"), F.transform("t", one).alias("paragraphs"))
    return snapshot_issues(c.select(F.col("conv_id").alias("id"), F.to_json(record).alias("json")))


_STATUS = "case s % 4 when 0 then 'confirmed' when 1 then 'review' when 2 then 'unresolved' else 'confirmed' end"
_MATCH = "case when i % 3 = 2 then 'unmatched' else 'matched_unique' end"


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, json) of derived bindings: each line of an order is a block and a physical group."""
    e = F.expr
    f = _facts(spark, sf_dir).withColumns({"status": e(_STATUS), "match": e(_MATCH)})
    span = F.struct(e("cast(case when status = 'unresolved' then null when s % 17 = 0 then q + 1 else 0 end as bigint)").alias("start"), e("cast(case when status = 'unresolved' or s % 19 = 0 then null else q end as bigint)").alias("end"), F.lit("host_snapshot_raw_text").alias("coordinate_system"), F.lit(OFFSETS).alias("encoding"))
    target = F.struct(e("case when status = 'unresolved' and s % 22 <> 0 then null when s % 13 = 0 then 'other' else concat('h', i) end").alias("host_paragraph_id"), span.alias("raw_span"))
    action = e("case when s % 29 = 0 then 'skip' else case status when 'confirmed' then 'verify_host_range' when 'review' then 'preview_only' else 'skip' end end")
    block = F.struct(F.col("i"), e("case when q % 23 = 0 then 'b' else concat('b', i) end").alias("block_id"), e("case when s % 31 = 0 then 'none' else concat('g', i) end").alias("physical_group_id"), F.struct(F.col("status"), action.alias("recommended_action")).alias("binding"), target.alias("host_target"))
    group = F.struct(F.col("i"), e("concat('g', case when q % 37 = 0 then 0 else i end)").alias("physical_group_id"), F.col("match").alias("status"), e("case when s % 7 = 0 then null else concat('h', i) end").alias("host_paragraph_id"))
    g = f.groupBy("d").agg(F.sort_array(F.collect_list(block)).alias("blocks"), F.sort_array(F.collect_list(group)).alias("groups"))
    count = lambda s: F.size(F.filter("blocks", lambda b: b["binding"]["status"] == s)).cast("bigint")
    summary = F.struct((F.size("blocks") + (F.col("d") % 11 == 0).cast("int")).cast("bigint").alias("total_blocks"), *[count(s).alias(f"{s}_blocks") for s in ACTIONS], F.lit(0).cast("bigint").alias("complete_physical_groups"), F.size("groups").cast("bigint").alias("incomplete_physical_groups"))
    without = lambda c: F.transform(c, lambda x: x.dropFields("i"))
    contracts = F.struct(F.lit(LOCATOR).alias("source_locator_version"), F.lit(HOST_TEXT).alias("host_text_contract_version"), F.lit(OFFSETS).alias("offset_encoding"))
    record = F.struct(F.lit(BINDING).alias("schema_version"), F.lit(CONTRACT).alias("integration_contract_version"), F.sha2(F.col("d").cast("string"), 256).alias("source_sha256"), contracts.alias("contracts"), summary.alias("summary"), without("groups").alias("physical_paragraphs"), without("blocks").alias("blocks"))
    return g.select(F.col("d").alias("id"), F.to_json(record).alias("json"))


_B = lambda when, path, reason=None: _issue_sql(when, path, reason, BINDING_CODE)


@query(f"""with f as ({_FACTS}), k as (select *, {_STATUS} as status, {_MATCH} as match, case when q % 23 = 0 then 'b' else 'b' || i end as block_id, case when s % 31 = 0 then 'none' else 'g' || i end as grp, 'g' || case when q % 37 = 0 then 0 else i end as own, case when s % 7 = 0 then null else 'h' || i end as host from f),
x0 as (select *, case when status = 'unresolved' and s % 22 <> 0 then null when s % 13 = 0 then 'other' else 'h' || i end as target, case when status = 'unresolved' then null when s % 17 = 0 then q + 1 else 0 end as a, case when status = 'unresolved' or s % 19 = 0 then null else q end as b,
  row_number() over (partition by d, block_id order by i) as nth, row_number() over (partition by d, own order by i) as nth_own, list(own) over (partition by d) as owns from k),
x as (select x0.*, (select arg_max(struct_pack(h := y.host), y.i) from x0 y where y.d = x0.d and y.own = x0.grp) as at_group, (select count(*) from x0 y where y.d = x0.d and y.grp = x0.own) as mine, (select count_if(y.status in ('confirmed', 'review')) from x0 y where y.d = x0.d and y.grp = x0.own) as fine from x0),
t as (select d, count(*) as n, count_if(match = 'matched_unique' and mine > 0 and mine = fine) as whole from x group by 1)
{_B('nth > 1', _AT + ".block_id'", 'duplicate_id')} union all {_B("status <> 'unresolved' and not list_contains(owns, grp)", _AT + ".physical_group_id'", 'unknown_physical_group')} union all {_B("s % 29 = 0 and status <> 'unresolved'", _AT + ".binding.recommended_action'")}
union all {_B("status = 'confirmed' and target is null", _AT + ".host_target.host_paragraph_id'")} union all {_B("status = 'confirmed' and at_group is not null and target is distinct from at_group.h", _AT + ".host_target.host_paragraph_id'", 'physical_group_host_mismatch')}
union all {_B("status = 'unresolved' and (target is not null or a is not null or b is not null)", _AT + ".host_target'", 'unresolved_executable_target')} union all {_B('(a is null) <> (b is null)', _AT + ".host_target.raw_span'", 'incomplete_span')}
union all {_B('a > b', _AT + ".host_target.raw_span'", 'invalid_span')} union all {_B("status <> 'unresolved' and a is null and b is null", _AT + ".host_target.raw_span'", 'incomplete_span')}
union all {_B('nth_own > 1', "'$.physical_paragraphs[' || i || '].physical_group_id'", 'duplicate_id')} union all {_B("match = 'matched_unique' and host is null", "'$.physical_paragraphs[' || i || '].host_paragraph_id'", 'missing_host_reference')}
union all select d, '{BINDING_CODE}', '$.summary.total_blocks', null from t where d % 11 = 0 union all select d, '{BINDING_CODE}', '$.summary.complete_physical_groups', null from t where whole <> 0 union all select d, '{BINDING_CODE}', '$.summary.incomplete_physical_groups', null from t where whole <> 0""")
def binding_contract_issues(spark, sf_dir):
    """Every issue of derived bindings: groups, actions, targets, spans and the counts of the summary."""
    return binding_issues(bindings(spark, sf_dir))
