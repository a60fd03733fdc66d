"""Queries that run whole flows over manifests made of the test tables: load, merge, report,
store, export, sessions. The manifests are small texts, as their sources are; the tables that
come of them are DataFrames."""

from __future__ import annotations

import asyncio
import contextlib
import json
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid import checks, write_safety
from loomgrid.ids import get_id, hash_column
from loomgrid.operators import derive as D
from loomgrid.operators import flatten as T
from loomgrid.operators.validate import declared_schema, validate
from loomgrid.plans import base_etl
from loomgrid.plans import export_manifest as E
from loomgrid.plans.dag import ETLSystem
from loomgrid.queries import _ID, _NATIONS, _ORDERS, _SHOP_PATHS, _nations, _shop_spine, customer_registry, flat, query, t
from loomgrid.registrar import Registrar
from loomgrid.registry import Registry
from loomgrid.session import decode_write, encode_write
from loomgrid.sources import manifest as S
from loomgrid.sources import store
from loomgrid.tables import shared_folder


@contextlib.contextmanager
def _case(spark: SparkSession) -> Iterator[None]:
    """A registrar tells fields apart by case; other queries needn't."""
    before = spark.conf.get("spark.sql.caseSensitive")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def _folder(spark: SparkSession) -> Path:
    out = Path(shared_folder(spark).removeprefix("file:")) / uuid.uuid4().hex
    out.mkdir(parents=True)
    return out


_FIELDS = {"value": {"type": "str", "nullable": "false", "range": ["AFRICA", "ASIA"]}, "rank": {"type": "float", "default": "1"}, "twin": {"type": "entity_ref"}, "note": {"type": "description"}}


def _geo(spark: SparkSession, sf: str) -> dict:
    """Regions with their nations; a nation's twin is its region."""
    out: dict = {"place": [{"field": _FIELDS}, "component_type"]}
    names = {}
    for r in t(spark, sf, "region").orderBy("r_regionkey").collect():
        names[r.r_regionkey] = r.r_name
        out[r.r_name] = {"data": [{"place": {"value": r.r_name, "note": f"  {r.r_name} \n"}}]}
    for n in t(spark, sf, "nation").orderBy("n_nationkey").collect():
        out[names[n.n_regionkey]][n.n_name] = [{"place": {"value": n.n_name, "rank": f"{n.n_nationkey} / 2", "twin": get_id("geo", names[n.n_regionkey])}}, "nation of earth"]
    return out


def _geo_registrar(spark: SparkSession, sf: str) -> Registrar:
    reg = Registrar(spark=spark)
    reg.update(yaml_strings={"geo": yaml.safe_dump(_geo(spark, sf), sort_keys=False)})
    return reg


_REGION_ID = "substr(sha256('geo:' || r_name), 1, 12)"
_NATION_ID = "substr(sha256('geo:' || r_name || '.' || n_name), 1, 12)"
_PAIR = "nation join region on n_regionkey = r_regionkey"


@query(f"""select 'geo:' || r_name || '.data[0].place.value' as path, r_name as value from region union all select 'geo:' || r_name || '.data[0].place.note', '  ' || r_name || ' ' || chr(10) from region
union all select 'geo:' || r_name || '.' || n_name || '[0].place.value', n_name from {_PAIR} union all select 'geo:' || r_name || '.' || n_name || '[0].place.rank', n_nationkey || ' / 2' from {_PAIR}
union all select 'geo:' || r_name || '.' || n_name || '[0].place.twin', {_REGION_ID} from {_PAIR} union all select 'geo:' || r_name || '.' || n_name || '[1].nation of earth', '' from {_PAIR}""")
def q_path_value_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest's text to rows of path and value."""
    geo = _geo(spark, sf)
    del geo["place"]
    raw = S.yaml_entities({"geo": yaml.safe_dump(geo, sort_keys=False)})
    return T.path_value_pairs(spark, raw).select("path", "value")


@query(f"select {_REGION_ID} as entity_id, r_name as entity_key, 'geo:' || r_name as entity_path, 'geo' as filepath from region union all select {_NATION_ID}, n_name, 'geo:' || r_name || '.' || n_name, 'geo' from {_PAIR} union all select substr(sha256('geo:place'), 1, 12), 'place', 'geo:place', 'geo'")
def q_entity_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All entities of a manifest."""
    return T.spine_rows(spark, {"geo": _geo(spark, sf)})


@query("select n_name, n_nationkey::int as n_nationkey, (row_number() over (order by n_name, n_nationkey) - 1)::bigint as component_index, 'nation_list_comp' as component_type, true as known from nation")
def q_csv_load(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV file as a component table of one entity, rows in the file's order."""
    folder = _folder(spark)
    rows = t(spark, sf, "nation").select("n_name", "n_nationkey").orderBy("n_name", "n_nationkey").toPandas()
    rows.to_csv(folder / "nation_list.csv", index=False)
    raw = S.csv_files(spark, folder)
    ((kind, table),) = S.csv_components(raw).items()
    ids = S.csv_spine(spark, raw).select("entity_id", F.lit(True).alias("known"))
    return table.join(ids, "entity_id", "left").select("n_name", "n_nationkey", "component_index", F.lit(kind).alias("component_type"), "known")


@query("""select 'yaml' as kind, 'm' || r_regionkey || '.yaml' as name, r_name || ':' as first_line from region union all select 'python', 'p' || r_regionkey || '.py', repeat(chr(34), 3) || r_name || repeat(chr(34), 3) from region""")
def q_source_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files found by suffix; the builtins are part of every load and are left out here."""
    folder = _folder(spark)
    for r in t(spark, sf, "region").collect():
        (folder / f"m{r.r_regionkey}.yaml").write_text(f"{r.r_name}:\n  - tagged\n")
        (folder / f"p{r.r_regionkey}.py").write_text(f'"""{r.r_name}"""\n')
        (folder / f"x{r.r_regionkey}.txt").write_text("neither")
    found = S.raw_strings(folder)
    rows = [(k, Path(n).name, text.splitlines()[0]) for k, texts in (("yaml", found["raw_yaml_strings"]), ("python", found["raw_python_strings"])) for n, text in texts.items() if Path(n).parent.name == folder.name]
    return spark.createDataFrame(rows, "kind string, name string, first_line string")


@query("""select 'r' || r_regionkey || '.py' as filepath, component_type, value from region, lateral (values ('calls', 'pack'), ('calls', 'go'), ('description', 'Goes to ' || r_name || '.')) as v(component_type, value)""")
def q_python_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Docstrings and calls of functions in Python texts, one text a region; calls of
    classes are left out."""
    texts = {f"r{r.r_regionkey}.py": f'def visit():\n    """Goes to {r.r_name}."""\n    pack()\n    self.go({r.r_regionkey})\n    Trip()\n' for r in t(spark, sf, "region").collect()}
    pairs = T.key_value_store(T.path_value_pairs(spark, S.python_entities(texts)))
    return pairs.where("component_type in ('calls', 'description') and field = 'value'").select("filepath", "component_type", "value")


@query(f"""select {_REGION_ID} as entity_id, r_name as entity_id_alias, r_name as place_value, 1.0::double as place_rank, null::varchar as place_twin, null::varchar as place_twin_eid, r_name as place_note from region
union all select {_NATION_ID}, r_name || '.' || n_name, n_name, n_nationkey / 2.0::double, {_REGION_ID}, {_REGION_ID}, null from {_PAIR}""")
def q_manifest_load(spark: SparkSession, sf: str) -> DataFrame:
    """The whole flow. Arithmetic, defaults, references and descriptions are resolved."""
    with _case(spark):
        return flat(_geo_registrar(spark, sf).view(["place"]))


@query(f"select {_REGION_ID} as entity_id, 0::bigint as component_index, 'place' as component_type, 'value' as field, r_name as value, 'range' as error_type from region where r_name not in ('AFRICA', 'ASIA') union all select {_NATION_ID}, 0, 'place', 'value', n_name, 'range' from {_PAIR}")
def q_invalid_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of a loaded manifest, as kept in its registry."""
    with _case(spark):
        return _geo_registrar(spark, sf).get("invalid_field").where("component_type = 'place'")


@query("select 'place' as component_type, 30::bigint as n union all select 'nation', 25 union all select 'field', 4")
def q_registry_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of a loaded registry by type, before validation."""
    pairs = T.key_value_store(T.path_value_pairs(spark, {"geo": _geo(spark, sf)}))
    spine = T.entity_spine(T.spine_rows(spark, {"geo": _geo(spark, sf)}))
    with base_etl.loaded_registry(spark, pairs, {}, spine, T.component_metadata(pairs)) as reg:
        kinds = [k for k in reg.component_types if k not in ("entity_id", "component_type")]
        return spark.createDataFrame([(k, reg.get(k).count()) for k in kinds], "component_type string, n bigint")


@query("select n_name as component_type, 'value' as field, 'double' as type from nation")
def q_declared_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types that are declared but have no data keep their schema."""
    n = t(spark, sf, "nation")
    path = F.concat(F.lit("geo:"), "n_name")
    spine = n.select(hash_column(path).alias("value"), path.alias("path"), F.col("n_name").alias("alias"), F.col("n_name").alias("entity_key"), F.lit("geo").alias("filepath"))
    place = lambda *more: spine.select(F.col("value").alias("entity_id"), F.lit(0).cast("bigint").alias("component_index"), F.lit(None).cast("string").alias("modifier"), *more)
    tables = {"entity_id": spine, "component_type": place(F.lit("component_type").alias("component_type"), F.lit(False).alias("derived"), F.lit(False).alias("skip_on_export")), "field": place(F.lit("value").alias("value"), F.lit("float").alias("type"))}
    reg = Registry(spark, schemas=validate(tables)[2])
    return spark.createDataFrame([(k, f.name, f.dataType.simpleString()) for k in reg.known_component_types for f in reg.get(k).schema.fields if f.name not in ("entity_id", "component_index", "modifier")], "component_type string, field string, type string")


@query("select 'x' as field, 'bigint' as type union all select 'b', 'boolean' union all select 'entity_id', 'string' union all select 'component_index', 'bigint' union all select 'modifier', 'string'")
def q_declared_schema(spark: SparkSession, sf: str) -> DataFrame:
    """The schema of a declared type."""
    found = declared_schema({"x": {"type": "int"}, "b": {"type": "bool"}})
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in found.fields], "field string, type string")


@query("select case when s_suppkey > m then substr(sha256('geo:n' || s_nationkey), 1, 12) else substr(sha256('shop:s' || s_suppkey), 1, 12) end as entity_id, s_acctbal from (select *, min(s_suppkey) over (partition by s_nationkey) as m from supplier)")
def q_same_as(spark: SparkSession, sf: str) -> DataFrame:
    """All suppliers of a nation but the first take the identity of the nation."""
    s = t(spark, sf, "supplier")
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("m"))
    named = lambda df, file, key, c: df.select(hash_column(F.concat(F.lit(f"{file}:{key}"), F.col(c).cast("string"))).alias("value"), F.concat(F.lit(f"{file}:{key}"), F.col(c).cast("string")).alias("path"), F.concat(F.lit(key), F.col(c).cast("string")).alias("alias"))
    spine = named(s, "shop", "s", "s_suppkey").unionByName(named(t(spark, sf, "nation"), "geo", "n", "n_nationkey"))
    ident = hash_column(F.concat(F.lit("shop:s"), F.col("s_suppkey").cast("string"))).alias("entity_id")
    same = s.join(first, "s_nationkey").where("s_suppkey > m").select(ident, F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("value"))
    return D.resolve_same_as({"entity_id": spine, "same_as": same, "account": s.select(ident, "s_acctbal")})["account"]


@query(f"""with s as {_NATIONS} select c_custkey, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then s.n_name else 'nowhere' end as home, case when c_custkey % 3 = 1 and (select count(*) from s x where contains(x.path, s.n_name)) = 1 then s.value end as home_eid
from customer join s on c_nationkey = s.n_nationkey""")
def q_resolve_references(spark: SparkSession, sf: str) -> DataFrame:
    """A reference field is found by its declaration and resolved, or null."""
    spine = _nations(spark, sf)
    owner = {"value": "o", "entity_key": "customer"}
    wanted = D.reference_fields([{"entity_id": "o", "value": "home", "type": "entity_ref"}, {"entity_id": "o", "value": "c_custkey", "type": "int"}], [owner])
    c = t(spark, sf, "customer").join(F.broadcast(spine), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    rows = c.select("c_custkey", F.when(k == 1, F.col("entity_key")).when(k == 2, "nowhere").alias("home"))
    return D.resolve_references({"customer": rows, "entity_id": spine}, wanted)["customer"]


@query(f"""with o as (select {_ID.format('o_custkey')} as entity_id, o_orderkey as component_index, o_orderdate, o_totalprice, o_orderstatus from orders),
old as (select entity_id, component_index, o_orderdate, o_totalprice, row_number() over (order by entity_id, component_index) as _seq_o_orderdate from o where o_orderstatus <> 'O'),
new as (select entity_id, component_index, o_orderdate, o_totalprice from o where o_orderstatus <> 'F' except select entity_id, component_index, o_orderdate, o_totalprice from old)
select * from old union all select *, (select coalesce(max(_seq_o_orderdate), 0) from old) + row_number() over (order by entity_id, component_index) from new""")
def q_registry_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches that overlap, merged into a registry that keeps their order."""
    whole = customer_registry(spark, sf)
    rows = whole.tables["orders"].drop("_seq_o_orderdate").join(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").drop("o_orderkey", "modifier")
    reg = Registry(spark)
    for status in ("O", "F"):
        batch = Registry(spark)
        batch.update({"orders": rows.where(F.col("o_orderstatus") != status).drop("o_orderstatus"), "entity_id": whole.tables["entity_id"], "field": whole.tables["field"]})
        reg.merge(batch)
    return reg.get("orders")


@query("select 'orders' as component_type, 'o_orderdate' as field union all select 'events', 'ts'")
def q_time_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Q5: time dimensions of the types."""
    return spark.createDataFrame(list(customer_registry(spark, sf, ("orders", "events")).time_fields().items()), "component_type string, field string")


@query("select substr(sha256('shop:customer.' || c_custkey), 1, 12) as entity_id, c_name as account_c_name, c_acctbal as account_c_acctbal from customer")
def q_view_pandas(spark: SparkSession, sf: str) -> DataFrame:
    """Q7: a view as a pandas table by entity."""
    df = customer_registry(spark, sf, ("account",)).view_df("account").reset_index()
    return flat(spark.createDataFrame(df[["entity_id", "account.c_name", "account.c_acctbal"]]))


@query(f"select r_name as ref, {_REGION_ID} as entity_id from region")
def q_entity_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Q8: ids by alias; a region's name stands in its nations' paths too, but an alias goes first."""
    reg = Registry(spark)
    reg.tables["entity_id"] = T.entity_spine(T.spine_rows(spark, {"geo": _geo(spark, sf)})).cache()
    names = [r.r_name for r in t(spark, sf, "region").collect()]
    return spark.createDataFrame([(n, reg.get_entity_id(n)) for n in names], "ref string, entity_id string")


@query(f"select 'orders' as component_type, o_orderkey::varchar as value from orders where o_custkey = 1 union all select 'account', c_name from customer where c_custkey = 1")
def q_entity_report(spark: SparkSession, sf: str) -> DataFrame:
    """K5, Q9: all components of one entity, by type."""
    found = customer_registry(spark, sf, ("orders", "account")).view_entity_df("customer.1")
    field = {"orders": "orders.o_orderkey", "account": "account.c_name"}
    return spark.createDataFrame([(k, str(v)) for k, df in found.items() if k in field for v in df[field[k]]], "component_type string, value string")


@query(f"select 'account' as component_type, count(*)::bigint as n from customer union all select 'orders', count(*) from {_ORDERS} union all select 'entity_id', count(*) + 3 from customer union all select 'field', 2")
def q_summary(spark: SparkSession, sf: str) -> DataFrame:
    """K4: the rows that the report gives each type."""
    text = customer_registry(spark, sf, ("orders", "account")).summarize_components(3)
    return spark.createDataFrame([(k, int(n)) for k, n in re.findall(r"^### (\S+): (\d+) rows$", text, re.M)], "component_type string, n bigint")


@query(f"select {_ID.format('o_custkey')} as entity_id, o_orderkey as component_index, null::varchar as modifier, o_orderdate, o_orderkey, o_totalprice, o_orderkey as _seq_o_orderdate from orders")
def q_store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A registry saved twice and loaded again."""
    url = str(_folder(spark))
    reg = customer_registry(spark, sf)
    store.save(Registry(spark, {"field": reg.tables["field"]}), url)
    store.save(reg, url)
    return store.load(spark, url).get("orders")


_BAD = """'{{"component_type": "place", "error_type": "range", "field": "value", "value": "' || {} || '"}}'"""


@query(f"""select r_name || '/place' as path, '{{"note": "' || r_name || '", "rank": 1.0, "value": "' || r_name || '"}}' as value from region
union all select r_name || '/' || n_name || '/place', '{{"rank": ' || (n_nationkey / 2.0::double) || ', "twin": "' || {_REGION_ID} || '", "value": "' || n_name || '"}}' from {_PAIR}
union all select r_name || '/' || n_name || '/nation of earth', 'tag' from {_PAIR}
union all select r_name || '/' || n_name || '/invalid_field', {_BAD.format('n_name')} from {_PAIR} union all select r_name || '/invalid_field', {_BAD.format('r_name')} from region where r_name not in ('AFRICA', 'ASIA')""")
def q_export_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The export of a loaded manifest, read back."""
    with _case(spark):
        (path,) = _geo_registrar(spark, sf).export_manifest(_folder(spark))
    rows = []

    def walk(above: list[str], body: object) -> None:
        if isinstance(body, list):
            for x in body:
                kind, value = (x, "tag") if isinstance(x, str) else (next(iter(x)), json.dumps(next(iter(x.values())), sort_keys=True))
                rows.append(("/".join([*above, kind]), value))
        else:
            for k, v in body.items():
                walk(above if k == "data" else [*above, k], v)

    found = yaml.safe_load(Path(path).read_text())
    found.pop("place")
    walk([], found)
    return spark.createDataFrame(rows, "path string, value string")


@query(f"select entity_id, component_index, parent_eid from (select substr(sha256(path), 1, 12) as entity_id, 3::bigint as component_index, substr(sha256('geo:' || n_name), 1, 12) as parent_eid from {_SHOP_PATHS})")
def q_components_for_export(spark: SparkSession, sf: str) -> DataFrame:
    """Parents that don't place their entity are exported as components."""
    s = _shop_spine(spark, sf)
    named = s.select(F.col("value").alias("entity_id"), F.lit(3).cast("bigint").alias("component_index"), F.lit(None).cast("string").alias("modifier"), hash_column(F.concat(F.lit("geo:"), "n_name")).alias("parent_eid"), F.lit(False).alias("is_primary"))
    parts = {"entity_id": s, "parent": D.hierarchy_parents(s).unionByName(named)}
    rest = E.non_hierarchy_parents(parts, E.entity_hierarchy(parts, s), s)
    return E.components_for_export(parts, rest)["parent"].select("entity_id", "component_index", "parent_eid")


@query("select 'account' as component_type")
def q_unexpected(spark: SparkSession, sf: str) -> DataFrame:
    """Types of an entity beyond those expected."""
    with _case(spark):
        reg = Registrar(customer_registry(spark, sf, ("orders", "account")))
        return spark.createDataFrame([(k,) for k in checks.unexpected_components(reg, "customer.1", ["orders"])], "component_type string")


@query("select max(o_orderkey)::double as at from orders where o_custkey = 7")
def q_write_time(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest time of an entity's rows."""
    with _case(spark):
        reg = Registrar(customer_registry(spark, sf))
        reg.registry.tables["orders"] = reg.registry.tables["orders"].withColumn("time", F.col("o_orderkey").cast("double"))
        return spark.createDataFrame([(checks.write_time(reg, "orders", "customer.7"),)], "at double")


@query("select r_name || '.place' as nested, 'colour of ' || r_name as unknown, true as names from region")
def q_write_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A component that stands as a child entity, and one that nobody defined."""
    rows = []
    for r in t(spark, sf, "region").collect():
        text = yaml.safe_dump({r.r_name: {"place": ["near"]}, "x": [f"colour of {r.r_name}", {"place": {"value": 1}}]})
        known = {"place", "near"}
        (nested,), (unknown,) = write_safety.nested_component_names(text, known), write_safety.unknown_component_types(text, known)
        rows.append((nested, unknown, write_safety.referenced_component_types(yaml.safe_load(text)) == {"near", "place", f"colour of {r.r_name}"}))
    return spark.createDataFrame(rows, "nested string, unknown string, names boolean")


@query("select r_name as text from region")
def q_token_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A write that waits for its confirmation travels as a token."""
    return spark.createDataFrame([(decode_write(encode_write(r.r_name)),) for r in t(spark, sf, "region").collect()], "text string")


@query("select r_name as said, 'saw ' || r_name as answer from region")
def q_tool_loop(spark: SparkSession, sf: str) -> DataFrame:
    """The loop of a model that calls one tool and then repeats the answer."""
    from loomgrid.agent import run_tool_loop

    async def complete(messages: list[dict], tools: list[dict]) -> dict:
        last = messages[-1]
        if last["role"] == "user":
            return {"message": {"content": None, "tool_calls": [{"id": "1", "name": "view_entity", "arguments": json.dumps({"entity_id": last["content"]})}]}}
        return {"message": {"content": last["content"]}}

    rows = [(r.r_name, asyncio.run(run_tool_loop(r.r_name, complete, lambda name, args: f"saw {args['entity_id']}"))) for r in t(spark, sf, "region").collect()]
    return spark.createDataFrame(rows, "said string, answer string")


@query("select unnest(['strings', 'raw_entity_first_data', 'raw_csv', 'csv_tables', 'pathvalue_pairs', 'keyvalue_store', 'entity_id_table', 'component_type_table', 'loaded_registry', 'initial_validated_registry', 'derived_registry', 'validated_registry']) as node")
def q_dag_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of the load flow, found by its name."""
    return spark.createDataFrame([(n,) for n in ETLSystem().outputs("base_etl")], "node string")


@query("select component_type, count(*)::bigint as n from (select case when r_name < 'B' then 'early' else 'late' end as component_type from region) group by component_type")
def q_dag_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """A node of a later flow replaces that of an earlier one; others feed on it."""
    from types import ModuleType

    def flow(name: str, code: str) -> ModuleType:
        out = ModuleType(name)
        exec(code, out.__dict__)  # noqa: S102
        return out

    base = flow("base_flow", "def kinds(names):\n    return ['none' for _ in names]\ndef counted(kinds):\n    return {k: kinds.count(k) for k in sorted(set(kinds))}\n")
    over = flow("over_flow", "def kinds(names):\n    return ['early' if n < 'B' else 'late' for n in names]\n")
    found = ETLSystem().execute([base, over], "counted", names=[r.r_name for r in t(spark, sf, "region").collect()])
    return spark.createDataFrame(list(found.items()), "component_type string, n bigint")
