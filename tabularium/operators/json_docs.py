"""Nested JSON documents: leaves, profiles, cleaning, flattening and field search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.functions.names import snake_case

# Key lists, categories and limits that must equal the reference's.
SYSTEM_KEYS = ["client_id", "user_id", "resource_id"]
FLATTEN_DEPTH, SAMPLE_VALUES = 3, 10
PERSONA_KEYS = [  # category, field names
    ("demographic", ["name", "age", "gender", "location", "occupation", "role", "position"]),
    ("demographic", ["program", "degree", "major", "department", "company", "school", "university"]),
    ("trait", ["gpa", "grade", "score", "rating", "performance"]),
    ("interest", ["interests", "skills", "hobbies", "specialties", "expertise"]),
    ("goal", ["goals", "career_goals", "objectives", "aspirations", "plans"]),
    ("trait", ["personality", "traits", "characteristics", "behavior"]),
]
CONTEXT_KEYS = {
    "academic": ["year_level", "semester", "academic_year", "course", "class"],
    "professional": ["experience_years", "position", "department", "company_size"],
    "personal": ["residence", "location", "status", "enrollment_status"],
    "temporal": ["created_at", "updated_at", "date", "timestamp"],
}
PERSONA_BUCKETS = {
    "Demographics": ["age", "gender", "program", "occupation", "role", "year_level"],
    "Performance": ["gpa", "grade", "score", "rating", "performance"],
    "Interests & Goals": ["interest", "goal", "aspiration", "career"],
    "Behavioral Patterns": ["status", "frequency", "usage", "participation", "residence"],
}
CONTEXT_BUCKETS = {
    "Institutional": ["institution", "university", "company", "organization"],
    "Temporal": ["year", "semester", "period", "date", "academic_year"],
    "Environmental": ["location", "residence", "environment", "setting"],
    "Academic/Professional": ["course", "class", "department", "program", "credit"],
}
NUMBERS_ONLY, BARE_VALUES = "Performance", "Interests & Goals"  # persona buckets with a form of their own
DEEP, MANY_FIELDS, NESTED, SOME_FIELDS = 4, 100, 2, 50


# ---- leaves ------------------------------------------------------------------------------------

AS_OBJECT = "try_variant_get({0}, '$', 'map<string,variant>')"
IS_OBJECT = "(try_variant_get({0}, '$', 'struct<`\x01`:variant>') IS NOT NULL)"  # reads no member


def deepest_nesting(df: DataFrame, text: str) -> int:
    """Largest number of nested objects and arrays in any document, from the brackets outside strings."""
    bare = F.replace(F.replace(F.col(text), F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    outside = F.array_join(F.filter(F.split(bare, '"'), lambda part, i: i % 2 == 0), "")
    brackets = F.regexp_replace(outside, r"[^\[\]{}]", "")
    step = F.aggregate(
        F.split(brackets, ""), F.struct(F.lit(0).alias("open"), F.lit(0).alias("top")),
        lambda a, c: F.struct(
            (a["open"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("open"),
            F.greatest(a["top"], a["open"] + F.when(c.isin("{", "["), 1).otherwise(0)).alias("top")),
        lambda a: a["top"])
    return df.agg(F.max(step)).first()[0] or 1


def json_leaves(
    df: DataFrame, key: str, text: str, max_depth: int | None = None, items: int | None = None,
    every_array: bool = False, keep_empty: bool = False,
) -> DataFrame:
    """One row per leaf: key, path, name, order, depth, type, value.

    Each level is one variant explode in the same scan. Objects extend the path by ``.key``, arrays of
    objects (every array with ``every_array``) by ``[i]``, at most the first ``items``. Without
    ``max_depth`` one aggregate finds the deepest nesting; a document beyond a given ``max_depth``
    raises instead of being cut.
    """
    if max_depth is None:
        max_depth = deepest_nesting(df, text)
    root = df.select(
        F.col(key).alias("key"), F.try_parse_json(text).alias("v"), F.lit("").alias("path"), F.lit("").alias("name"),
        F.array().cast("array<int>").alias("order"), F.lit(0).alias("depth"),
    ).where(IS_OBJECT.format("v"))
    spark = df.sparkSession
    skipped = ", ".join(f"'{k}'" for k in SYSTEM_KEYS)
    array_test = "first_item IS NOT NULL" if every_array else IS_OBJECT.format("first_item")
    kept = "inner_pos IS NOT NULL OR NOT (is_object OR is_array)" + (" OR true" if keep_empty else "")
    cut = f"AND NOT (is_array AND inner_pos >= {items})" if items is not None else ""
    frontier = root
    for _ in range(max_depth):
        frontier = spark.sql(f"""
            SELECT key, CASE WHEN inner_pos IS NULL THEN v ELSE inner_value END AS v,
              CASE WHEN inner_pos IS NULL THEN path WHEN is_array THEN concat(path, '[', inner_pos, ']')
                   WHEN path = '' THEN inner_key ELSE concat(path, '.', inner_key) END AS path,
              coalesce(inner_key, name) AS name,
              CASE WHEN inner_pos IS NULL THEN `order` ELSE array_append(`order`, inner_pos) END AS `order`,
              CASE WHEN inner_pos IS NULL THEN depth ELSE depth + 1 END AS depth
            FROM (SELECT *, {IS_OBJECT.format('v')} AS is_object, coalesce({array_test}, false) AS is_array
                  FROM (SELECT *, try_variant_get(v, '$[0]', 'variant') AS first_item FROM {{frontier}})),
            LATERAL variant_explode_outer(CASE WHEN is_object OR is_array THEN v END) AS t(inner_pos, inner_key, inner_value)
            WHERE ({kept}) AND coalesce(inner_key, '') NOT IN ({skipped}) {cut}
        """, frontier=frontier)
    kind = F.expr("schema_of_variant(v)")
    deeper = F.expr(f"coalesce(size({AS_OBJECT.format('v')}) > 0, false)")
    value = F.when(deeper, F.raise_error(F.lit(f"document is nested deeper than {max_depth} levels")).cast("string")
                   ).otherwise(F.expr("try_variant_get(v, '$', 'string')"))
    label = (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
        .when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "integer")
        .when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").otherwise("numeric")
    )
    return frontier.select(
        F.col("key").alias(key), "path", "name", "order", "depth", label.alias("type"), value.alias("value"))


def leaf_profile(leaves: DataFrame) -> DataFrame:
    """Per path: type over all non-null values, nulls, values, distinct values and the ten smallest of them as samples."""
    bit = F.when(F.col("type") == "boolean", 1).when(F.col("type") == "integer", 2).when(F.col("type") == "numeric", 4).when(F.col("type") == "string", 8).otherwise(16)
    filled = F.col("value").isNotNull()
    # one row for each value, with the types it came in as bits, so the second count has nothing to make distinct
    counted = leaves.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("types"))
    first = F.row_number().over(W.partitionBy("path").orderBy(F.col("value").asc_nulls_last()))
    samples = (
        counted.select("path", "value").withColumn("at", first).where(F.col("at") <= SAMPLE_VALUES).where(filled).groupBy("path")
        .agg(F.array_sort(F.collect_list("value")).alias("samples"))
    )
    types = F.bit_or(F.when(filled, F.col("types")))
    kind = (
        F.when(types.isNull(), "null").when(types == 1, "boolean").when(types == 2, "integer")
        .when(types.isin(4, 6), "numeric").when(types == 8, "string").otherwise("mixed")
    )
    profile = counted.groupBy("path").agg(
        kind.alias("type"), F.bool_or(~filled).alias("nullable"), F.sum("n").alias("values"), F.count("value").alias("unique_count"))
    shown = F.coalesce("samples", F.array().cast("array<string>"))
    return profile.join(samples, "path", "left").withColumn("samples", shown)


def document_shape(df: DataFrame, key: str, text: str, max_depth: int | None = None) -> DataFrame:
    """Nesting depth, field count, complexity label and kinds of values per document."""
    # What is known of a document before its leaves goes with its key, so nothing is joined to it afterwards.
    commas = F.length(text) - F.length(F.replace(F.col(text), F.lit(","), F.lit("")))
    known = F.struct(F.col(key).alias("key"), (commas + 1).alias("fields"), F.monotonically_increasing_id().alias("row"))
    leaves = json_leaves(df.select(known.alias("document"), text), "document", text, max_depth, every_array=True, keep_empty=True)
    has_array = F.bool_or(F.contains("path", F.lit("[")) | (F.col("type") == "list"))
    has_number = F.bool_or(F.col("type").isin("integer", "numeric", "boolean"))
    kinds = F.array_compact(F.array(
        F.when(has_array, "arrays"), F.when(F.bool_or(F.col("type") == "string"), "categorical"),
        F.lit("nested_objects"), F.when(has_number, "numerical")))
    shape = leaves.groupBy("document").agg(F.max("depth").alias("max_depth"), kinds.alias("kinds")).select(
        F.col("document.key").alias(key), "max_depth", "kinds", "document.fields")
    deep = (F.col("max_depth") > DEEP) | (F.col("fields") > MANY_FIELDS)
    some = (F.col("max_depth") > NESTED) | (F.col("fields") > SOME_FIELDS)
    return shape.withColumn(
        "complexity", F.when(deep, "high").when(some, "medium").otherwise("low"))


def field_type_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Total, numeric and list fields per document over all nested objects, and the number of nested objects.

    Lists are not entered; booleans count as numbers. Null for what is no JSON object, or names a field twice in one
    object. The text is reduced to its name colons, brackets and one letter per number; the stretches between list
    brackets are then counted where no list is open.
    """
    bare = F.regexp_replace(F.col(text), rf"(?s){_STRING}(?:\s*+(:))?|(?:null|[\s,}}])++", "$1")
    bare = F.regexp_replace(bare, r"true|false|[-0-9][0-9eE+.-]*+", "n")

    def step(a: Column, part: Column) -> Column:
        first = F.substring(part, 1, 1)
        opened = a["open"] + F.when(first == "[", 1).when(first == "]", -1).otherwise(0)
        count = lambda sign: F.when(opened == 0, F.length(part) - F.length(F.replace(part, F.lit(sign), F.lit("")))).otherwise(0)
        return F.struct(
            opened.alias("open"), (a["total"] + count(":")).alias("total"), (a["numeric"] + count("n")).alias("numeric"),
            (a["lists"] + F.when((first == "[") & (a["open"] == 0), 1).otherwise(0)).alias("lists"),
            (a["objects"] + count("{")).alias("objects"))

    none = F.struct(*[F.lit(n).alias(name) for name, n in (("open", 0), ("total", 0), ("numeric", 0), ("lists", 0), ("objects", -1))])
    is_object = F.col(text).rlike(r"^\s*+\{") & F.try_parse_json(text).isNotNull()
    counted = df.select(key, F.when(_is_one_value(F.col(text)) & is_object, F.aggregate(F.split(bare, r"(?=[\[\]])"), none, step)).alias("c"))
    return counted.select(key, *[F.col(f"c.{n}").cast("long").alias(n) for n in ("total", "numeric", "lists", "objects")])


# ---- cleaning ----------------------------------------------------------------------------------

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SNAKE = r'"[a-z0-9]++(?:_[a-z0-9]++)*+":'
_EMPTY = rf"(?:{_STRING}:)?(?:null|\{{\}}|\[\])"  # of a compact text: a member or an element
_MARK = "\x01"  # no JSON text holds it


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _is_one_value(text: Column) -> Column:
    """Whether a text is one JSON value with nothing behind it."""
    return F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1


def _without_empties(compact: Column) -> Column:
    """A compact text without the members and elements that are null, {} or [], each with one of the commas next to it."""
    before_end, elsewhere = rf"(?:,{_EMPTY})++(?=[\]}}])", rf"(?<=[\[{{,]){_EMPTY}(?:,|(?=[\]}}]))"
    return F.regexp_replace(compact, rf"(?s){before_end}|{elsewhere}|({_STRING}:?)", "$1")


def _with_snake_names(compact: Column) -> Column:
    """A compact text with names in snake_case, escapes in names decoded first. Only names that differ are cut out."""
    marked = F.regexp_replace(compact, rf"(?s)((?:[^\"]++|{_SNAKE}|{_STRING}(?!:))*+)({_STRING}:|\z)", f"$1{_MARK}$2")

    def renamed(part: Column) -> Column:
        name = F.regexp_extract(part, rf"(?s)^{_STRING}", 0)
        plain = F.when(F.contains(name, F.lit("\\")), F.get_json_object(F.concat(F.lit('{"k":'), name, F.lit("}")), "$.k")).otherwise(name)
        words = F.btrim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))
        return F.concat(F.lit('"'), words, F.lit('"'), F.substring(part, F.length(name) + 1, F.length(part)))

    parts = F.split(marked, _MARK)
    return F.array_join(F.transform(parts, lambda p, i: F.when((i > 0) & (p != ""), renamed(p)).otherwise(p)), "")


def _printed(tokens: Column) -> Column:
    """Tokens without commas as JSON text with the commas they need."""
    def with_comma(x: Column, i: Column) -> Column:
        before = F.get(tokens, i - 1)
        starts = F.endswith(before, F.lit(":")) | before.isin("{", "[")
        return F.when((i > 0) & ~x.isin("}", "]") & ~starts, F.concat(F.lit(","), x)).otherwise(x)

    return F.array_join(F.transform(tokens, with_comma), "")


def _last_members(tokens: Column) -> Column:
    """The tokens without members whose name comes again later in the same object."""
    def step(a: Column, x: Column) -> Column:
        depth = F.size(a["open"])
        opened = F.when(x == "{", F.array_append(a["open"], a["at"])).when(x == "}", F.slice(a["open"], 1, depth - 1))
        named = F.struct(F.get(a["open"], depth - 1).alias("object"), a["at"].alias("at"), x.alias("name"))
        return F.struct(
            (a["at"] + 1).alias("at"), opened.otherwise(a["open"]).alias("open"),
            F.when(F.endswith(x, F.lit(":")), F.array_append(a["names"], named)).otherwise(a["names"]).alias("names"))

    none = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<int>").alias("open"),
        F.array().cast("array<struct<object:int,at:int,name:string>>").alias("names"))

    def without(names: Column) -> Column:
        again = lambda m: F.exists(names, lambda o: (o["object"] == m["object"]) & (o["name"] == m["name"]) & (o["at"] > m["at"]))
        ranges = F.filter(  # a repeated member ends where the next member of its object begins
            F.transform(names, lambda m, i: F.struct(m["at"].alias("a"), F.get(names, i + 1)["at"].alias("b"), again(m).alias("again"))),
            lambda r: r["again"])
        return _bound(ranges, lambda rs: F.filter(tokens, lambda x, i: ~F.exists(rs, lambda r: (r["a"] <= i) & (i < r["b"]))))

    return _bound(F.array_sort(F.aggregate(tokens, none, step)["names"]), without)


def _flat(value: Column, max_depth: int) -> Column:
    """A JSON object (a variant) with nested objects joined by ``_`` down to ``max_depth`` levels, as text; lists and
    deeper objects stay values. Members come in the order of their names; of repeated names the last stays."""
    def members(v: Column) -> Column:
        return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))

    def inner(e: Column, prefix: Column) -> Column:
        named = F.transform(members(e["value"]), lambda c: F.struct(F.concat(prefix, c["key"]).alias("key"), c["value"].alias("value")))
        return F.coalesce(named, F.array(e))

    found = members(value)
    for _ in range(max_depth - 1):  # a field without a name adds none
        found = F.flatten(F.transform(found, lambda e: inner(e, F.when(e["key"] == "", "").otherwise(F.concat(e["key"], F.lit("_"))))))
    found = F.flatten(F.transform(found, lambda e: inner(e, F.concat(e["key"], F.lit("_")))))

    def printed(entries: Column) -> Column:
        distinct = F.size(F.array_distinct(F.transform(entries, lambda e: e["key"]))) == F.size(entries)
        last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
        return F.to_json(F.map_from_entries(F.when(distinct, entries).otherwise(last)))

    return _bound(found, printed)


def clean_json(
    text: Column | str, remove_empty: bool = True, snake_keys: bool = True, flatten: bool = False, max_depth: int = FLATTEN_DEPTH
) -> Column:
    """Cleaned JSON text; a text that does not parse becomes null.

    ``remove_empty`` leaves out members and list elements that are null, {} or [] as written (a container that becomes
    empty stays), ``snake_keys`` renames every field. Numbers and strings stay as written; of fields of one object
    whose names are equal the last one stays. ``flatten`` joins nested objects by ``_``, at the root or in each object
    of a list at the root (other elements are left out, a scalar document is null). All of it is one projection of
    passes over the text that step over strings, without Python and without a shuffle.
    """
    column = F.col(text) if isinstance(text, str) else text
    # from one white space outside strings to the next, so a text without any is read once and not copied
    compact = F.regexp_replace(column, rf"(?s)\G((?:[^\"\s]++|{_STRING})*+)\s++", "$1")
    compact = _without_empties(compact) if remove_empty else compact
    compact = _with_snake_names(compact) if snake_keys else compact

    def flattened(v: Column) -> Column:
        objects = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())
        listed = F.concat(F.lit("["), F.array_join(F.transform(objects, lambda x: _flat(x, max_depth)), ","), F.lit("]"))
        return F.coalesce(_flat(v, max_depth), listed)

    def checked(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(rf"(?s){_STRING}:|{_STRING}|[\[\]{{}}]|[^\[\]{{}},\":]++"), F.lit(0))
        last = _bound(_bound(tokens, _last_members), _printed)
        if flatten:
            return _bound(F.try_parse_json(t), lambda v: F.when(v.isNotNull(), flattened(v)).otherwise(_bound(F.try_parse_json(last), flattened)))
        return F.when(F.try_parse_json(t).isNotNull(), t).otherwise(_bound(last, lambda x: F.when(F.try_parse_json(x).isNotNull(), x)))

    return F.when(_is_one_value(column), _bound(compact, checked))


# ---- typed documents ---------------------------------------------------------------------------

def snake_schema(kind: T.DataType) -> T.DataType:
    """The type with snake_case field names at every level."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(snake_case(f.name), snake_schema(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(snake_schema(kind.elementType), kind.containsNull)
    return kind


def normalize_struct_keys(df: DataFrame) -> DataFrame:
    """Rename nested fields by a cast; no value is touched."""
    return df.select(*[F.col(f"`{f.name}`").cast(snake_schema(f.dataType)).alias(snake_case(f.name)) for f in df.schema.fields])


def flatten_struct(df: DataFrame, max_depth: int = FLATTEN_DEPTH) -> DataFrame:
    """Nested structs as columns joined by ``_`` down to ``max_depth`` levels, decided from the schema."""
    def columns(kind: T.StructType, at: str, prefix: str, depth: int) -> list[Column]:
        found = []
        for f in kind.fields:
            source, name = f"{at}`{f.name}`", f"{prefix}_{f.name}" if prefix else f.name
            if isinstance(f.dataType, T.StructType) and depth < max_depth:
                found += columns(f.dataType, source + ".", name, depth + 1)
            else:
                found.append(F.col(source).alias(name))
        return found

    return df.select(*columns(df.schema, "", "", 0))


def document_rows(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of flattened documents: one per array element, one per scalar, in one scan.

    Elements of object arrays become rows of their fields, elements of simple arrays and scalars a row
    with that single field; null scalars give no row.
    """
    fields: dict[str, T.DataType] = {}
    body = [f for f in df.schema.fields if f.name not in keys]

    def element(f: T.StructField) -> T.StructType | None:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else None
        return kind if isinstance(kind, T.StructType) else None

    for f in body:
        if element(f) is not None:
            fields.update({x.name: x.dataType for x in element(f).fields})
        else:
            fields[f.name] = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType

    def row(values: dict[str, Column]) -> Column:
        return F.struct(*[values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in fields.items()])

    def rows_of(f: T.StructField) -> Column:
        column, inner = F.col(f"`{f.name}`"), element(f)
        if inner is not None:
            return F.transform(column, lambda x: row({n: x[n] for n in inner.names}))
        if isinstance(f.dataType, T.ArrayType):
            return F.transform(column, lambda x: row({f.name: x}))
        return F.filter(F.array(F.when(column.isNotNull(), row({f.name: column}))), lambda x: x.isNotNull())

    parts = [rows_of(f) for f in body]
    nothing = F.array().cast(T.ArrayType(T.StructType([T.StructField(n, k) for n, k in fields.items()])))
    rows = F.concat(*[F.coalesce(p, nothing) for p in parts])
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


# ---- fields by meaning -------------------------------------------------------------------------

def _category_of_name(table: dict[str, list[str]]) -> Column:
    pairs: dict[str, str] = {}
    for category, names in table.items():
        for name in names:
            pairs.setdefault(name, category)
    return F.create_map(*[F.lit(x) for item in pairs.items() for x in item])[F.lower("name")]


def _shown() -> Column:
    """The value as text; a list as its values with commas between them."""
    listed = F.array_join(F.transform(F.from_json("value", "array<string>"), lambda x: F.coalesce(x, F.lit("None"))), ", ")
    return F.coalesce(F.when(F.col("type") == "list", listed).otherwise(F.col("value")), F.lit("None"))


def titled(name: Column) -> Column:
    return F.initcap(F.regexp_replace(name, "_", " "))


def persona_fields(leaves: DataFrame, key: str) -> DataFrame:
    """Leaves whose field name marks a demographic, trait, interest or goal, with a readable label."""
    number = F.create_map(*[F.lit(x) for i, (_, names) in enumerate(PERSONA_KEYS) for n in names for x in (n, i)])[F.lower("name")]
    category = F.array(*[F.lit(c) for c, _ in PERSONA_KEYS])[F.col("__rule")]
    plain = F.concat(titled(F.col("name")), F.lit(": "), F.coalesce("value", F.lit("None")))
    level = F.concat(F.lit("Academic/Performance level: "), titled(F.col("name")), F.lit(" of "), F.coalesce("value", F.lit("None")))
    listed = F.concat(titled(F.col("name")), F.lit(": "), _shown())
    character = F.concat(F.when(F.col("type") == "list", "Personality traits: ").otherwise("Personality: "), _shown())
    forms = F.when(F.col("__rule") == 2, level).when(F.col("__rule") == 3, listed).when(F.col("__rule") == 5, character).otherwise(plain)
    found = leaves.withColumn("__rule", number).where("__rule IS NOT NULL")
    return found.select(key, "path", category.alias("category"), forms.alias("label"))


def context_fields(leaves: DataFrame, key: str) -> DataFrame:
    """Leaves whose field name gives academic, professional, personal or temporal context, with a readable label."""
    found = leaves.withColumn("category", _category_of_name(CONTEXT_KEYS)).where("category IS NOT NULL")
    value = F.coalesce("value", F.lit("None"))
    current = F.concat(F.lit("Currently in "), F.replace(F.col("name"), F.lit("_"), F.lit(" ")), F.lit(": "), value)
    dated = F.concat(F.lit("Data from: "), value)
    label = F.when(F.col("category") == "academic", current).when(F.col("category") == "temporal", dated).otherwise(F.concat(titled(F.col("name")), F.lit(": "), value))
    return found.select(key, "path", "category", "value", label.alias("label"))


def bucketed_fields(leaves: DataFrame, key: str, buckets: dict[str, list[str]], per_bucket: int | None = None) -> DataFrame:
    """Distinct labelled values per bucket; the first bucket with a word in the path wins.

    The performance bucket takes numbers only, the interests bucket bare values, of a list each one. ``per_bucket``
    keeps the first few for a short report; without it all are returned.
    """
    path, chain = F.lower("path"), None
    for name, terms in buckets.items():
        test = F.lit(False)
        for term in terms:
            test = test | path.contains(term)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    value = F.coalesce("value", F.lit("None"))
    label = F.array(F.concat(F.initcap(F.regexp_replace("path", "[_.]", " ")), F.lit(": "), value))
    bare = F.when(F.col("type") == "list", F.coalesce(F.from_json("value", "array<string>"), F.array(value))).otherwise(F.array(value))
    numeric = F.col("type").isin("integer", "numeric", "boolean")
    found = leaves.withColumn("bucket", chain).where("bucket IS NOT NULL").where((F.col("bucket") != NUMBERS_ONLY) | numeric)
    labels = F.when(F.col("bucket") == BARE_VALUES, bare).otherwise(label)
    found = found.select(key, "bucket", F.explode(labels).alias("label")).distinct()
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(key, "bucket").orderBy("label")))
    return ranked if per_bucket is None else ranked.where(F.col("rank") <= per_bucket)


def fields_for_question(leaves: DataFrame, key: str, question: str) -> DataFrame:
    """Leaves whose path shares a word with the question."""
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(question.lower().split())])
    path_words = F.split(F.replace(F.lower("path"), F.lit("_"), F.lit(" ")), r"\s+")
    return leaves.where(F.arrays_overlap(path_words, asked)).select(key, "path", "value")


def value_for_field(leaves: DataFrame, key: str, field: str, description: str = "", values: int | None = None) -> DataFrame:
    """Values (all, or the first ``values``) whose path contains a word of the wanted field or its description."""
    terms = [w for w in field.lower().split("_") + description.lower().split() if w]
    test = F.lit(False)
    for term in terms:
        test = test | F.lower("path").contains(term)
    first = W.partitionBy(key).orderBy("order")
    ranked = leaves.where(test).withColumn("rank", F.row_number().over(first))
    return (
        (ranked if values is None else ranked.where(F.col("rank") <= values))
        .select(key, "rank", F.concat(titled(F.col("path")), F.lit(": "), F.coalesce("value", F.lit("None"))).alias("label"))
    )
