"""Arithmetic expressions, guarded SQL, tools and tool routing. Agents run on the driver; what they call returns DataFrames or text."""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import InvalidArgument

_FUNCTIONS: dict[str, tuple[int, Callable[..., float], Callable[..., Column]]] = {
    "sin": (1, math.sin, F.sin), "cos": (1, math.cos, F.cos), "tan": (1, math.tan, F.tan), "asin": (1, math.asin, F.asin), "acos": (1, math.acos, F.acos), "atan": (1, math.atan, F.atan),
    "sqrt": (1, math.sqrt, F.sqrt), "abs": (1, abs, F.abs), "ln": (1, math.log, F.log), "log": (1, math.log10, F.log10), "exp": (1, math.exp, F.exp),
    "floor": (1, math.floor, lambda x: F.floor(x).cast("double")), "ceil": (1, math.ceil, lambda x: F.ceil(x).cast("double")), "round": (1, lambda x: math.copysign(math.floor(abs(x) + 0.5), x), F.round),
    "pow": (2, math.pow, F.pow), "min": (2, min, F.least), "max": (2, max, F.greatest),
}
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(\S))")


def parse_expression(text: str, names: tuple[str, ...] = ()):
    """A tree of ('num', x), ('name', n), ('neg', a), (operator, a, b), ('call', f, args). Unary minus binds tighter than ^; ^ goes right to left."""
    tokens = [(m[1], m[2], m[3]) for m in _TOKEN.finditer(text.rstrip())]
    at = 0

    def peek() -> str:
        return "" if at == len(tokens) else next(x for x in tokens[at] if x is not None)

    def take(what: str = "") -> tuple:
        nonlocal at
        if at == len(tokens) or (what and peek() != what):
            raise InvalidArgument(f"expected {what or 'more'} in {text!r}")
        at += 1
        return tokens[at - 1]

    def binary(operators: str, below, right: bool = False):
        left = below()
        while peek() in tuple(operators) and peek():
            op = take()[2]
            left = (op, left, binary(operators, below, True) if right else below())
            if right:
                break
        return left

    def expression():
        return binary("+-", lambda: binary("*/", lambda: binary("^", unary, True)))

    def unary():
        if peek() in ("-", "+"):
            sign = take()[2]
            inner = unary()
            return ("neg", inner) if sign == "-" else inner
        number, name, sign = take()
        if number is not None:
            return ("num", float(number))
        if sign == "(":
            inner = expression()
            take(")")
            return inner
        if name is None:
            raise InvalidArgument(f"unexpected {sign} in {text!r}")
        low = name.lower()
        if peek() == "(" and low in _FUNCTIONS:
            take("(")
            args = [expression()]
            while peek() == ",":
                take(",")
                args.append(expression())
            take(")")
            if len(args) != _FUNCTIONS[low][0]:
                raise InvalidArgument(f"{low} takes {_FUNCTIONS[low][0]} arguments")
            return ("call", low, args)
        if low in ("pi", "e"):
            return ("num", math.pi if low == "pi" else math.e)
        if name in names:
            return ("name", name)
        raise InvalidArgument(f"unknown name {name}")

    tree = expression()
    if at != len(tokens):
        raise InvalidArgument(f"unexpected {peek()} in {text!r}")
    return tree


def evaluate(text: str) -> float:
    """The value of an arithmetic expression."""

    def value(t) -> float:
        match t:
            case ("num", x):
                return x
            case ("neg", a):
                return -value(a)
            case ("call", f, args):
                return float(_FUNCTIONS[f][1](*map(value, args)))
            case (op, a, b):
                x, y = value(a), value(b)
                if op == "/" and y == 0:
                    raise InvalidArgument("division by zero")
                return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "^": lambda: math.pow(x, y)}[op]()

    try:
        return float(value(parse_expression(text)))
    except (OverflowError, ValueError) as e:
        raise InvalidArgument(str(e)) from e


def expression_column(text: str, names: tuple[str, ...] = ()) -> Column:
    """The same as a column over the named columns; null where it divides by zero."""

    def column(t) -> Column:
        match t:
            case ("num", x):
                return F.lit(x)
            case ("name", n):
                return F.col(n).cast("double")
            case ("neg", a):
                return -column(a)
            case ("call", f, args):
                return _FUNCTIONS[f][2](*map(column, args))
            case (op, a, b):
                x, y = column(a), column(b)
                return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / F.nullif(y, F.lit(0.0)), "^": lambda: F.pow(x, y)}[op]()

    return column(parse_expression(text, names))


DENIED = "insert update delete drop alter create truncate replace attach detach grant revoke".split()
DENIED_FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user user session_user current_catalog current_database current_schema version".split())
FORMATS = frozenset("parquet csv json orc text avro xml binaryfile delta jdbc".split())


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


@dataclass
class Used:
    """What a parsed query names: tables (as dotted lower-case names), functions, and whatever can't be checked."""

    tables: dict[str, None] = field(default_factory=dict)
    functions: dict[str, None] = field(default_factory=dict)
    unchecked: list[str] = field(default_factory=list)


def used_by(spark: SparkSession, sql: str) -> Used:
    """Names in the parsed query. A WITH name hides a table only where it is visible: after its definition, in its own query."""
    out, gateway = Used(), spark.sparkContext._gateway

    def expression(e, scope: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            out.functions[".".join(_items(e.nameParts())).lower()] = None
        elif "UnresolvedIdentifier" in kind:
            out.unchecked.append("IDENTIFIER()")
        if is_instance_of(gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            plan(e.plan(), scope)
        for c in _items(e.children()):
            expression(c, scope)

    def plan(node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            recursive = node.allowRecursion()
            for cte in _items(node.cteRelations()):
                name = cte._1().lower()
                plan(cte._2(), scope | {name} if recursive else scope)
                scope |= {name}
        elif kind == "UnresolvedRelation":
            parts = [x.lower() for x in _items(node.multipartIdentifier())]
            if len(parts) > 1 or parts[0] not in scope:
                out.tables[".".join(parts)] = None
        elif kind == "ScriptTransformation" or "TableValuedFunction" in kind or "UnresolvedIdentifier" in kind or "Command" in kind:
            out.unchecked.append(kind)
        for e in _items(node.expressions()):
            expression(e, scope)
        for c in _items(node.children()):
            plan(c, scope)

    plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset())
    return out


@dataclass
class GuardedSql:
    """Read-only SQL with allow-lists, a row limit and a time budget; every call can be audited.

    Tables and functions come from the parsed plan, each WITH name in its own scope, and columns are refused by the analyser, so
    aliases, subqueries and expressions can't hide them. Functions are the built-in ones but for those that reach outside
    the query (``DENIED_FUNCTIONS``), and ``functions``. Scripts, table functions, files as tables and computed names are refused.
    """

    spark: SparkSession
    tables: list[str] | None = None
    columns: dict[str, list[str]] | None = None
    max_rows: int = 200
    max_ms: int = 2500
    audit: Callable[[dict], None] | None = None
    functions: tuple[str, ...] = ()

    def check_text(self, sql: str) -> str:
        flat = " ".join(sql.split()).lower()
        if not flat:
            raise InvalidArgument("missing sql")
        if ";" in sql:
            raise InvalidArgument("several statements are not allowed")
        if not flat.startswith(("select ", "with ")):
            raise InvalidArgument("only SELECT and WITH are allowed")
        for word in DENIED:
            if f" {word} " in f" {flat} ":
                raise InvalidArgument(f"forbidden keyword: {word}")
        return flat

    def check_names(self, sql: str) -> list[str]:
        """The tables that the query reads, if it may."""
        used = used_by(self.spark, sql)
        if used.unchecked:
            raise InvalidArgument(f"not allowed: {used.unchecked[0]}")
        jvm = self.spark._jvm.org.apache.spark.sql.catalyst
        own = {f.lower() for f in self.functions}
        for f in used.functions:
            if f in DENIED_FUNCTIONS or (f not in own and not jvm.analysis.FunctionRegistry.builtin().functionExists(jvm.FunctionIdentifier(f))):
                raise InvalidArgument(f"function not allowed: {f}")
        policies = {t.lower() for t in self.columns or {}}
        for t in used.tables:
            qualified = "." in t and t.rpartition(".")[2] in policies
            if (self.tables is not None and t not in {x.lower() for x in self.tables}) or t.partition(".")[0] in FORMATS or qualified:
                raise InvalidArgument(f"table not allowed: {t}")
        return list(used.tables)

    def frame(self, sql: str, params: dict | None = None) -> DataFrame:
        """The query's DataFrame, once it has passed the guard; not limited."""
        flat = self.check_text(sql)
        named = self.check_names(sql)
        seen = {t: c for t, c in (self.columns or {}).items() if t.lower() in named}
        if seen and re.search(r"\bselect\s+(?:distinct\s+)?(?:\w+\s*\.\s*)?\*", flat):
            raise InvalidArgument("wildcards are not allowed with a column policy")
        # each table is hidden behind a query of its allowed columns, so the analyser itself refuses all others
        hidden = ", ".join(f"{t} AS (SELECT {', '.join(f'`{c}`' for c in cs)} FROM {t})" for t, cs in seen.items())
        if hidden:
            body = sql.strip()
            sql = f"WITH {hidden}, {body[4:]}" if flat.startswith("with ") else f"WITH {hidden} {body}"
        try:
            return self.spark.sql(sql, args=params or {})
        except AnalysisException as e:
            if seen and (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                raise InvalidArgument(f"column not allowed: {str(e).splitlines()[0]}") from e
            raise

    def run(self, sql: str, params: dict | None = None) -> dict:
        began = time.monotonic()
        event: dict = {"sql": sql, "params": params or {}}
        try:
            rows = [r.asDict() for r in self.frame(sql, params).limit(self.max_rows + 1).collect()]
            ms = round((time.monotonic() - began) * 1000)
            if ms > self.max_ms:
                raise InvalidArgument(f"query exceeded its budget: {ms} ms > {self.max_ms} ms")
            out = {"ok": True, "columns": list(rows[0]) if rows else [], "row_count": min(len(rows), self.max_rows), "truncated": len(rows) > self.max_rows, "duration_ms": ms, "rows": rows[: self.max_rows]}
            event |= {"ok": True, "duration_ms": ms, "row_count": out["row_count"], "truncated": out["truncated"]}
        except Exception as e:  # the tool reports errors as text
            out = {"ok": False, "error": str(e).splitlines()[0]}
            event |= {"ok": False, "error": out["error"]}
        if self.audit:
            self.audit(event)
        return out


@dataclass
class Tool:
    name: str
    description: str
    call: Callable[[dict], str]


def _show(df: DataFrame, columns: list[str] | None = None, most: int = 1000) -> str:
    """A tool's rows as JSON, for a reader; the first ``most`` of them."""
    return json.dumps([r.asDict(recursive=True) for r in (df.select(*columns) if columns else df).limit(most).collect()], ensure_ascii=False, default=str)


def standard_tools(explorer=None, geo=None, qa=None, sql: GuardedSql | None = None, get: Callable[[str], str] | None = None, hosts: list[str] | None = None) -> dict[str, Tool]:
    """The tools for what is given. ``get`` fetches a URL (injected; nothing here opens a connection)."""
    tools = [Tool("math", "evaluates an arithmetic expression", lambda i: f"{evaluate(i.get('expression', '')):.12g}")]
    if explorer is not None:
        tools += [
            Tool("corpus_stats", "counts documents and bytes", lambda i: _show(explorer.stats())),
            Tool("doc_search", "searches the documents", lambda i: _show(explorer.search(i["query"], int(i.get("k", 5))), ["doc_id", "start", "end", "score", "text"])),
            Tool("doc_summarize", "sentences that answer a query", lambda i: _show(explorer.summarize(i["query"], int(i.get("sentences", 3))))),
            Tool("entity_extract", "entities in the documents", lambda i: _show(explorer.entities(i.get("types")))),
            Tool("regex_extract", "matches of a pattern", lambda i: _show(explorer.regex(i["pattern"], int(i.get("limit", 50))))),
            Tool("glossary", "frequent words", lambda i: _show(explorer.glossary(int(i.get("top", 12))))),
        ]
    if geo is not None:
        tools.append(Tool("geo_resolver", "finds places", lambda i: _show(geo.search_place(i["query"], int(i.get("k", 5))))))
    if qa is not None:
        tools.append(Tool("rag_qa", "answers from the documents", lambda i: qa.ask(i["question"], int(i.get("k", 3)))["answer"]))
    if sql is not None:
        tools.append(Tool("db_query", "runs guarded SQL", lambda i: json.dumps(sql.run(i.get("sql", ""), i.get("params")), default=str)))
    if get is not None:
        tools.append(Tool("weather", "current weather", lambda i: get(f"weather?lat={float(i['lat'])}&lon={float(i['lon'])}")))

        def fetch(i: dict) -> str:
            host = re.sub(r"^https?://([^/]+).*$", r"\1", i["url"])
            if hosts is not None and host not in hosts:
                return f"host not allowed: {host}"
            return get(i["url"])

        tools.append(Tool("free_api", "gets a public URL", fetch))
    return {t.name: t for t in tools}


def call_tool(instruction: str, tools: dict[str, Tool]) -> str:
    """tool:NAME {json}; else a guide to the tools."""
    m = re.fullmatch(r"tool:([\w-]+)\s*(\{.*\})?", instruction.strip(), re.S)
    if not m:
        return "Use tool:NAME {json}. Tools: " + ", ".join(f"{t.name} ({t.description})" for t in tools.values())
    if m[1] not in tools:
        return f"Unknown tool: {m[1]}"
    return tools[m[1]].call(json.loads(m[2] or "{}"))


def parse_decision(raw: str) -> dict:
    """A model's JSON decision, without a code fence; anything else is a final answer."""
    clean = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", raw.strip(), flags=re.I))
    try:
        d = json.loads(clean)
    except ValueError:
        d = None
    if not isinstance(d, dict):
        return {"type": "final", "content": raw}
    if d.get("type") == "tool_call":
        tool = str(d.get("tool") or "")
        return {"type": "tool_call", "tool": tool, "input": d["input"] if isinstance(d.get("input"), dict) else {}} if tool else {"type": "final", "content": raw}
    return {"type": "final", "content": str(d["content"]) if d.get("content") is not None else raw}


_MATH = r"[0-9].*[-+*/^]|(?:sin|cos|tan|sqrt)\("


def heuristic_decision(messages: list[dict], tools: dict[str, Tool]) -> dict:
    """math, weather, db_query, rag_qa in this order; the last tool result ends it."""
    user, result = "", None
    for m in reversed(messages):
        if m["role"] == "tool" and result is None:
            result = m["content"]
        if m["role"] == "user":
            user = m["content"].lower()
            break
    if result:
        return {"type": "final", "content": f"Tool result: {result}"}
    if "math" in tools and re.search(_MATH, user):
        found = re.search(r"(?:[a-z]+\(|[\d.(])[\d\s.+\-*/^(),a-z]*[\d)]", user)
        return {"type": "tool_call", "tool": "math", "input": {"expression": (found[0] if found else user).strip()}}
    if "weather" in tools and re.search("weather|temperature", user):
        return {"type": "tool_call", "tool": "weather", "input": {"lat": -15.3875, "lon": 28.3228}}
    if "db_query" in tools and re.search("sql|database|db |orders|customers", user):
        return {"type": "tool_call", "tool": "db_query", "input": {"sql": "SELECT * FROM orders LIMIT 5", "params": {}}}
    if "rag_qa" in tools:
        return {"type": "tool_call", "tool": "rag_qa", "input": {"question": user, "k": 3}}
    return {"type": "final", "content": "No suitable tool found."}


def route_column(text: Column | str) -> Column:
    """The tool that ``heuristic_decision`` would pick for a user's message, with all tools there."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.when(low.rlike(_MATH), "math").when(low.rlike("weather|temperature"), "weather").when(low.rlike("sql|database|db |orders|customers"), "db_query").otherwise("rag_qa")


@dataclass
class RoutingAgent:
    """A model decides on tools until it answers, at most ``most`` times."""

    tools: dict[str, Tool]
    model: Callable[[list[dict], dict[str, Tool]], dict] = heuristic_decision
    most: int = 8
    trace: list[dict] = field(default_factory=list)

    def chat(self, message: str) -> dict:
        messages = [{"role": "user", "content": message}]
        self.trace = []
        for _ in range(self.most):
            d = self.model(messages, self.tools)
            if d["type"] == "final":
                return {"answer": d["content"], "tool_calls": self.trace}
            name = d["tool"]
            try:
                result = self.tools[name].call(d["input"]) if name in self.tools else f"Unknown tool: {name}"
            except Exception as e:  # a failing tool is something the model should see
                result = f"{name} failed: {e}"
            self.trace.append({"tool": name, "input": d["input"], "result": result})
            messages.append({"role": "tool", "content": result})
        return {"answer": "No answer within the allowed steps.", "tool_calls": self.trace}
