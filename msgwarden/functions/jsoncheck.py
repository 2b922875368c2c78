"""JSON texts: well-formedness and the schema keywords that become column predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sqltext import any_of, quoted

# Session setting under which a repeated key keeps its last value instead of failing.
DUPLICATE_KEYS_CONF = "spark.sql.variant.allowDuplicateKeys"

# NaN and the infinities are accepted outside strings; they are quoted for the parser.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NON_FINITE = rf'(?s)\G((?:[^"NI-]++|{_STRING}|-(?!Infinity))*+)(-?Infinity|NaN)'


def _parse_whole(text: Column) -> Column:
    # The parser stops after the first value. Behind the text stands its own digest: only a
    # text that is exactly one value leaves the digest in the second place of the array.
    seal = F.md5(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]')))
    sealed = F.try_variant_get(wrapped, "$[1]", "string") == seal
    return F.when(sealed, F.try_variant_get(wrapped, "$[0]", "variant"))


def parse_json(text: Column) -> Column:
    """The text as VARIANT, or NULL unless the whole text is one JSON value.

    ``NaN``, ``Infinity`` and ``-Infinity`` are accepted as values and kept as strings, which
    cast to the same doubles. A key that is repeated keeps its last value, which takes a session
    setting (:func:`msgwarden.session.prepare`); without it the query is refused, as its verdicts
    would differ.
    """
    session = SparkSession.getActiveSession()
    if session is None or session.conf.get(DUPLICATE_KEYS_CONF, "false").lower() != "true":
        raise ValueError(f"set {DUPLICATE_KEYS_CONF} to true, or pass the session through prepare")
    quoted = F.regexp_replace(text, _NON_FINITE, '$1"$2"')
    odd = text.contains("NaN") | text.contains("Infinity")
    return F.coalesce(_parse_whole(text), F.when(odd, _parse_whole(quoted)))


def kind(value: str) -> str:
    """SQL for object, array, string, boolean, number or null; NULL where there is no value."""
    # the schema is worked out once and looked up; all that is not listed is some kind of number
    names = "map('OBJECT', 'object', 'STRING', 'string', 'ARRAY', 'array', 'BOOLEAN', 'boolean', 'VOID', 'null')"
    word = f"split_part(schema_of_variant({value}), '<', 1)"
    return f"IF({value} IS NULL, NULL, coalesce(try_element_at({names}, {word}), 'number'))"


def at(value: str, keys: tuple[str, ...], kind_: str = "variant") -> str:
    """SQL for the value under the keys, NULL where it is absent or of another kind."""
    path = "$" + "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in keys)
    return f"try_variant_get({value}, {quoted(path)}, '{kind_}')"


_KEYWORDS = {
    "type", "properties", "required", "additionalProperties", "minLength", "maxLength", "enum",
}
_NOTES = {"description", "title", "default", "examples", "$schema", "$id", "$comment"}


def _check_keywords(schema: dict, where: str) -> None:
    unknown = set(schema) - _KEYWORDS - _NOTES
    if unknown:
        raise ValueError(f"unsupported schema keywords at {where}: {sorted(unknown)}")
    if schema.get("additionalProperties", True) not in (True, False):
        raise ValueError(f"additionalProperties at {where} must be true or false")


class _Written:
    """Where the parts of a schema find what they test: spelled out from the parsed column."""

    def __init__(self, parsed: str):
        self.parsed = parsed

    def value(self, keys: tuple[str, ...]) -> str:
        return at(self.parsed, keys) if keys else self.parsed

    def kind(self, keys: tuple[str, ...]) -> str:
        return kind(self.value(keys))

    def text(self, keys: tuple[str, ...]) -> str:
        return at(self.value(keys), (), "string")

    def n_keys(self, keys: tuple[str, ...]) -> str:
        return f"size(try_variant_get({self.value(keys)}, '$', 'map<string,variant>'))"


class _Staged(_Written):
    """The same as columns, each worked out once, a value from that of its parent."""

    def __init__(self, parsed: str):
        super().__init__(parsed)
        self.values: dict[tuple, str] = {}
        self.facts: dict[str, str] = {}

    def value(self, keys: tuple[str, ...]) -> str:
        if not keys:
            return self.parsed
        if keys not in self.values:
            self.value(keys[:-1])
            self.values[keys] = f"__n{len(self.values)}"
        return self.values[keys]

    def _fact(self, what: str, keys: tuple[str, ...], expression: str) -> str:
        column = f"__{what}_{self.value(keys)}"
        self.facts[column] = expression
        return column

    def kind(self, keys: tuple[str, ...]) -> str:
        return self._fact("kind", keys, super().kind(keys))

    def text(self, keys: tuple[str, ...]) -> str:
        return self._fact("text", keys, super().text(keys))

    def n_keys(self, keys: tuple[str, ...]) -> str:
        return self._fact("keys", keys, super().n_keys(keys))

    def onto(self, df: DataFrame) -> DataFrame:
        deepest = max(map(len, self.values), default=0)
        for depth in range(1, deepest + 1):
            level = {c: at(self.value(keys[:-1]), keys[-1:]) for keys, c in self.values.items() if len(keys) == depth}
            df = df.withColumns({c: F.expr(e) for c, e in level.items()})
        return df.withColumns({c: F.expr(e) for c, e in self.facts.items()})


def with_schema_errors(df: DataFrame, parsed: str, schema: dict, out: str) -> DataFrame:
    """The frame with ``out``: the codes of :func:`schema_errors`. Every value, its kind and its keys are taken once."""
    look = _Staged(parsed)
    codes = _codes(schema, look)
    return look.onto(df).withColumn(out, _listed(codes)).drop(*look.values.values(), *look.facts)


def schema_errors(parsed: str, schema: dict) -> Column:
    """Codes of the schema rules that a parsed text breaks, as ``array<string>``.

    ``parsed`` names a column made by :func:`parse_json`. Codes read ``path:keyword``, with
    ``$:json`` alone for a text that is not JSON. The schema is read on the driver while the
    query is built; a keyword outside the supported ones is refused there.
    """
    return _listed(_codes(schema, _Written(parsed)))


def _listed(codes: list[str]) -> Column:
    return F.expr(f"array_compact(array({', '.join(codes)}))")


def _codes(schema: dict, look: _Written) -> list[str]:
    parsed = look.parsed
    codes = [f"CASE WHEN {parsed} IS NULL THEN '$:json' END"]

    def visit(node: dict, keys: tuple[str, ...]) -> None:
        where = ".".join(("$",) + keys)
        _check_keywords(node, where)
        what = look.kind(keys)

        def broken(keyword: str, cond: str) -> None:
            codes.append(f"CASE WHEN {parsed} IS NOT NULL AND {cond} THEN {quoted(f'{where}:{keyword}')} END")

        if "type" in node:
            fits = []
            for wanted in node["type"] if isinstance(node["type"], list) else [node["type"]]:
                if wanted == "integer":
                    number = at(look.value(keys), (), "double")
                    fits.append(f"({what} = 'number' AND {number} = floor({number}))")
                else:
                    fits.append(f"{what} = {quoted(wanted)}")
            broken("type", f"NOT {any_of(fits)}")
        for keyword, sign in (("minLength", "<"), ("maxLength", ">")):
            if keyword in node:
                broken(keyword, f"{what} = 'string' AND length({look.text(keys)}) {sign} {int(node[keyword])}")
        if "enum" in node:
            if not all(isinstance(v, str) for v in node["enum"]):
                raise ValueError(f"enum at {where} must list strings")
            listed = ", ".join(quoted(v) for v in node["enum"])
            broken("enum", f"NOT ({what} = 'string' AND {look.text(keys)} IN ({listed}))")
        for required in node.get("required", ()):
            broken(f"required:{required}", f"{what} = 'object' AND {look.value((*keys, required))} IS NULL")
        if node.get("additionalProperties", True) is False:
            known = [f"CAST({look.value((*keys, k))} IS NOT NULL AS INT)" for k in node.get("properties", {})]
            broken("additionalProperties", f"{what} = 'object' AND {look.n_keys(keys)} > {' + '.join(['0', *known])}")
        for key, child in node.get("properties", {}).items():
            visit(child, (*keys, key))

    visit(schema, ())
    return codes
