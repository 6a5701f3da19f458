"""Tools that a chat turn can call on tables, their registry, and what a model's reply is read for. Models are functions of the caller."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clustering
from .operators import lexical as X
from .sources import text_tables as C

#: Turns that a planner sees, characters of a tool's result that a prompt shows, what a reply without a meaning becomes.
TURNS, SHOWN, LOST = 10, 3000, "I'm not sure how to help with that. Could you rephrase?"
# How calls and fenced objects are recognised in a reply.
_CALL = re.compile(r"tool|action", re.IGNORECASE)
_FENCED_CALL = re.compile(r"```(?:json)?\s*\{[^`]*?(?:tool|action)[^`]*?\}\s*```", re.DOTALL | re.IGNORECASE)
_FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.DOTALL)


def balanced(text: str, start: int = 0) -> str | None:
    """The JSON object that begins at the first brace from `start` on, by its braces outside strings; None if it doesn't end."""
    start = text.find("{", start)
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def _object(text: str | None) -> dict | None:
    try:
        found = json.loads(text or "")
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def plain_reply(text: str | None) -> str:
    """What a reply says, without calls: an envelope {"text": ...} is opened, fenced and bare objects of tools or actions are taken out."""
    text = text or ""
    if text.strip().startswith("{") and (found := _object(text.strip())) and "text" in found and not {"tool", "action"} & set(found):
        return plain_reply(found["text"])
    text, at = _FENCED_CALL.sub("", text), 0
    while (at := text.find("{", at)) >= 0:
        whole = balanced(text, at) if _CALL.search(text[at : at + 60]) else None
        if whole:
            text = text[:at] + text[at + len(whole) :]
        else:
            at += 1
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def flat_object(text: str) -> dict:
    """A fenced object, else the first object without another in it, else an empty one."""
    for found in (_FENCED.search(text), re.search(r"(\{[^{}]*\})", text, re.DOTALL)):
        if found and (value := _object(found[1])) is not None:
            return value
    return {}


def string_list(text: str | None) -> list | None:
    """The first bracketed part that is a JSON list."""
    found = re.search(r"\[.*?\]", text or "", re.DOTALL)
    try:
        value = json.loads(found[0]) if found else None
    except ValueError:
        return None
    return value if isinstance(value, list) else None


@dataclass
class Planned:
    """A planner's decision: a tool with parameters, or a text."""

    tool: str | None = None
    params: dict = field(default_factory=dict)
    text: str | None = None
    raw: str = ""


def decide(raw: str) -> Planned:
    """Reads a planner's reply: a fenced object, the whole reply, or its first balanced object names a tool or holds the text; else the reply is the text."""
    fenced = _FENCED.search(raw)
    source = fenced[1] if fenced else raw.strip() if raw.strip().startswith("{") else balanced(raw)
    found = _object(source)
    if found:
        if name := found.get("tool") or found.get("action"):
            return Planned(tool=name, params=found.get("params") or {}, raw=raw)
        if "text" in found:
            return Planned(text=plain_reply(found["text"]), raw=raw)
    return Planned(text=plain_reply(raw) or LOST, raw=raw)


@dataclass
class State:
    """What a session holds between turns."""

    wordlist: list[str] | None = None
    latest_data: str | None = None
    last_output: dict | None = None
    latest_data_source: str | None = None
    latest_data_rows: int = 0
    matrix_languages: int = 0
    matrix_concepts: int = 0
    active_layers: dict = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)
    data_updated_this_turn: bool = False

    def summary(self) -> str:
        parts = [f"wordlist ({len(self.wordlist)} concepts)"] if self.wordlist else []
        parts += [f"latest_data ({self.latest_data_rows} rows)"] if self.latest_data else []
        return ", ".join(parts) or "none"

    def said(self, user: str, assistant: str) -> None:
        self.history += [{"role": "user", "content": user}, {"role": "assistant", "content": assistant}]

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @classmethod
    def from_json(cls, text: str | None) -> State:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (_object(text) or {}).items() if k in known})


@dataclass
class Result:
    tool: str
    success: bool
    data: dict | None = None
    error: str | None = None


def _csv(f):
    """A tool on csv text: an empty text, or an error of the table's, is a result that says so."""

    def run(spark: SparkSession, csv_data: str = "", **more) -> dict:
        if not (csv_data or "").strip():
            return {"ok": False, "error": "Empty CSV data"}
        return f(spark, csv_data, **more)

    return run


@_csv
def read_csv(spark, csv_data, **_):
    columns, n, head = C.preview(C.parse_csv(spark, csv_data))
    return {"ok": True, "csv_data": csv_data, "columns": columns, "row_count": n, "preview": head}


@_csv
def normalize(spark, csv_data, **_):
    df = C.parse_csv(spark, csv_data)
    names = C.standard_names(df.columns)
    if missing := C.missing_columns([names.get(c, c.strip()) for c in df.columns]):
        return {"ok": False, "error": f"Normalization failed. Missing required columns: {', '.join(missing)}.", "missing": missing}
    text = C.csv_text(C.normalised(df))
    return {"ok": True, "csv_data": text, "row_count": df.count(), "warnings": []}


@_csv
def binary_matrix(spark, csv_data, **_):
    df = C.parse_csv(spark, csv_data)
    key = next((c for c in ("Glottocode", "LangID") if c in df.columns), None)
    if key is None or not {"Concept", "Form"} <= set(df.columns):
        return {"error": "Concept, Form and Glottocode or LangID are needed", "summary": {}}
    meta = [c for c in ("Glottocode", "LangID", "Language Family", "Language Name", "Latitude", "Longitude") if c in df.columns]
    concepts = [r[0] for r in df.select("Concept").dropna().distinct().orderBy("Concept").collect()]
    out = X.binary_matrix(df, meta, "Concept", "Form", concepts)
    mean = out.agg(*[F.avg(f"`{c}`").alias(f"a{i}") for i, c in enumerate(concepts)]).first() if concepts else []
    n = out.count()
    return {"csv_data": C.csv_text(out), "summary": {"languages": n, "concepts": len(concepts), "avg_coverage": round(100 * sum(x or 0 for x in mean) / len(concepts), 1) if concepts else 0.0}}


@_csv
def cluster(spark, csv_data, params=None, **_):
    p = params or {}
    try:
        out = clustering.cluster(C.parse_csv(spark, csv_data), p.get("min_cluster_size", 5), p.get("min_samples", 3), p.get("metric", "jaccard")).cache()
    except ValueError as e:
        return {"error": str(e), "summary": {}}
    return {"csv_data": C.csv_text(out), "summary": clustering.summary(out).first().asDict()}


def propose_wordlist(spark, topic="", constraints=None, llm=None, **more):
    """A list of concepts that a model is asked for."""
    about = {**more, **(constraints or {})}
    if llm is None:
        return {"wordlist": [], "error": "No LLM function provided"}
    reply = llm(f"List at most {about.get('max_terms', 30)} basic concepts about {topic}" + "".join(f", {k} {about[k]}" for k in ("region", "domain") if about.get(k)) + ". Answer with a JSON list of strings.")
    if not reply:
        return {"wordlist": [], "error": "Empty LLM response"}
    found = string_list(reply)
    return {"wordlist": [], "error": "No JSON list in response"} if found is None else {"wordlist": found, "notes": f"Generated {len(found)} concepts for {topic}"}


#: The header of a table that a model is asked for; fixed value.
HARVEST = ("Glottocode", "Language Family", "Language Name", "Latitude", "Longitude", "Concept", "Form")


def collect_rows(spark, wordlist=None, scope=None, llm=None, **_):
    """A table of words in many languages that a model is asked for, as csv text."""
    if llm is None or not wordlist:
        return {"csv_data": "", "error": "No LLM function provided" if llm is None else "No wordlist available."}
    reply = llm(f"For the concepts {json.dumps(wordlist)}{f' and the languages of {scope}' if scope else ''} give a csv table with the header {','.join(HARVEST)}.") or ""
    rows = [x for x in reply.splitlines() if x.count(",") >= len(HARVEST) - 1]
    return {"csv_data": "\n".join(rows) + "\n" if rows else "", "wordlist": wordlist}


def query_words(spark, glosses=(), dataset="Combined", lat=None, lon=None, radius_km=None, tables=None, **_):
    """Located forms of the glosses, upper-cased, of one dataset or all, near a point if one is given, as csv text."""
    if not glosses:
        return {"error": "No glosses given"}
    l, f, p = tables["languages"], tables["forms"], tables["parameters"]
    rows = X.located(X.star(l, f, p, [g.upper() for g in glosses]))
    rows = rows if dataset.startswith("Combined") else rows.filter(F.col("dataset_name") == dataset)
    if None not in (lat, lon, radius_km):
        rows = X.in_box(rows, lat, lon, radius_km)
    found = rows.select("ID", "Name", "Glottocode", "Latitude", "Longitude", "form_value", "parameter_name", "dataset_name")
    text = C.csv_text(found)
    return {"csv_data": text, "row_count": text.count("\n") - 1}


def search_concepts(spark, query="", tables=None, **_):
    from .functions.text import like_any_case

    found = tables["parameters"].filter(like_any_case(F.col("Concepticon_Gloss"), query)).select("Concepticon_Gloss").distinct().orderBy("Concepticon_Gloss")
    return {"wordlist": [r[0] for r in found.collect()]}


def layer_query(spark, layername="", user_request="", bbox=None, frontend_context="", llm=None, **_):
    """A query that a model proposes for a layer; it isn't run."""
    if llm is None:
        return {"type": "query_plan", "layername": layername, "plan": {}}
    where = f" Keep to latitudes {bbox[0]} to {bbox[1]} and longitudes {bbox[2]} to {bbox[3]}." if bbox else ""
    return {"type": "query_plan", "layername": layername, "plan": flat_object(llm(f"Layer '{layername}', columns: {frontend_context}. Request: {user_request}.{where} Answer with a JSON object with the SQL over the table data under 'query'."))}


def style_patch(spark=None, layername="", column_names=None, field=None, palette=None, patch=None, **_):
    patch = dict(patch or {})
    if field:
        if column_names is not None and field not in column_names:
            return {"error": f"Field '{field}' does not exist in the provided columns {column_names}."}
        patch["vizField"] = field
    return {"type": "style_patch", "layername": layername, "patch": patch | ({"palette": palette} if palette else {})}


TOOLS: dict[str, Callable[..., dict]] = {
    "propose_wordlist": propose_wordlist, "collect_multilingual_rows": collect_rows, "read_csv": read_csv, "normalize_spoken_language_csv": normalize, "to_binary_matrix": binary_matrix, "cluster": cluster,
    "query_spatial_linguistic_data": query_words, "layer_query_plan": layer_query, "search_available_concepts": search_concepts, "style_patch": style_patch,
}
ON_CSV = ("read_csv", "normalize_spoken_language_csv", "to_binary_matrix", "cluster")


def run_tool(spark: SparkSession, name: str, params: Mapping[str, Any], state: State, llm: Callable[[str], str] | None = None, tables: Mapping[str, DataFrame] | None = None) -> Result:
    """Runs a tool with what the session holds for parameters that are missing, and takes its results into the session. Whatever goes wrong is a result without success."""
    if name not in TOOLS:
        return Result(name, False, error=f"Unknown tool: {name}")
    given = dict(params)
    if name in ON_CSV and state.latest_data:
        given.setdefault("csv_data", state.latest_data)
    if name == "collect_multilingual_rows" and state.wordlist:
        given.setdefault("wordlist", state.wordlist)
    if name in ON_CSV and not given.get("csv_data"):
        return Result(name, False, error="No data available.")
    if name == "collect_multilingual_rows" and not given.get("wordlist"):
        return Result(name, False, error="No wordlist available.")
    try:
        data = TOOLS[name](spark, **given, llm=llm, tables=tables)
    except Exception as e:  # noqa: BLE001  a tool's failure is its result
        return Result(name, False, error=str(e) or type(e).__name__)
    if data.get("wordlist"):
        state.wordlist = data["wordlist"]
    text = data.get("csv_data")
    if text and name != "read_csv":
        state.latest_data, state.data_updated_this_turn = text, True
        state.latest_data_rows = data.get("row_count", max(0, text.count("\n") - 1))
        state.latest_data_source = {"collect_multilingual_rows": "harvest", "query_spatial_linguistic_data": "query"}.get(name, state.latest_data_source)
    if name == "to_binary_matrix" and "summary" in data:
        state.matrix_languages, state.matrix_concepts = data["summary"].get("languages", 0), data["summary"].get("concepts", 0)
    state.last_output = data
    return Result(name, True, data)


def shown(result: Result, most: int = SHOWN) -> str:
    """A result as a prompt shows it."""
    return json.dumps(asdict(result), default=str)[:most]


def turn(spark: SparkSession, state: State, message: str, llm: Callable[[list[dict]], str], tables: Mapping[str, DataFrame] | None = None, upload: str | None = None) -> tuple[str, Result | None]:
    """One chat turn: the planner decides on a tool or a text; after a tool the model words its result. (reply, the tool's result)."""
    state.data_updated_this_turn = False
    if upload:
        state.latest_data, state.latest_data_source, state.latest_data_rows = upload, "upload", max(0, upload.strip().count("\n"))
    head = {"role": "system", "content": f"Tools: {', '.join(TOOLS)}. The session holds: {state.summary()}. Answer with a JSON object, of tool and params or of text."}
    try:
        plan = decide(llm([head, *state.history[-TURNS:], {"role": "user", "content": message}]))
    except Exception as e:  # noqa: BLE001  a model out of reach is an answer too
        plan = Planned(text=f"LLM error: {e}")
    if plan.tool is None:
        state.said(message, plan.text)
        return plan.text, None
    result = run_tool(spark, plan.tool, plan.params, state, lambda prompt: llm([{"role": "user", "content": prompt}]), tables)
    reply = plain_reply(llm([{"role": "user", "content": f"Request: {message}\nResult of {plan.tool}: {shown(result)}\nSay in a few words what came of it."}])) or LOST
    state.said(message, reply)
    return reply, result
