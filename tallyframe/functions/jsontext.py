"""JSON documents as Python values: paths, repair and the three text forms used for scoring."""

from __future__ import annotations

import json
import re
from typing import Any

from .similarity import align


def is_empty(value: Any) -> bool:
    """None, "", [] and {} only."""
    return value is None or isinstance(value, (str, list, dict)) and len(value) == 0


def paths(value: Any) -> dict[str, Any]:
    """Dotted path -> value of every object key, parents included; lists are leaves."""
    out: dict[str, Any] = {}
    waiting = [("", value)]
    while waiting:
        prefix, node = waiting.pop()
        if isinstance(node, dict):
            for k in reversed(node):
                waiting.append((f"{prefix}.{k}" if prefix else str(k), node[k]))
        if prefix:
            out[prefix] = node
    return out


def leaf_lines(value: Any, prefix: str = "") -> dict[str, str]:
    """Leaf path (with [i] for list items) -> text with white space normalised."""
    if isinstance(value, (dict, list)):
        items = value.items() if isinstance(value, dict) else enumerate(value)
        out: dict[str, str] = {}
        for k, v in items:
            name = f"{prefix}[{k}]" if isinstance(value, list) else f"{prefix}.{k}" if prefix else str(k)
            out.update(leaf_lines(v, name))
        return out
    return {prefix: " ".join(str("" if value is None else value).split())}


def path_get(value: Any, path: str) -> Any:
    """The value at a dotted path; through a list it gathers one level and drops None; nothing found is None."""
    for depth, key in enumerate(parts := path.split(".")):
        if isinstance(value, list):
            rest = ".".join(parts[depth:])
            found = [x for item in value if (x := path_get(item, rest)) is not None]
            flat = [y for x in found for y in (x if isinstance(x, list) else [x]) if y is not None]
            return flat or None
        if not isinstance(value, dict) or key not in value:
            return None
        value = value[key]
    return value


def project(value: Any, fields: list[str]) -> Any:
    """The configured fields, by dotted path; missing ones are left out, error objects and an empty list pass everything."""
    if not fields or not isinstance(value, dict) or "erro" in value:
        return value
    out: dict[str, Any] = {}
    for path in fields:
        found = path_get(value, path)
        if found is None:
            continue
        node, (*parents, last) = out, path.split(".")
        for key in parents:
            node = node.setdefault(key, {})
        node[last] = found
    return out


def count_keys(value: Any) -> int:
    if isinstance(value, dict):
        return len(value) + sum(map(count_keys, value.values()))
    return sum(map(count_keys, value)) if isinstance(value, list) else 0


def flatten_list(value: list) -> list:
    return [y for x in value for y in (flatten_list(x) if isinstance(x, list) else [x])]


def structure(pred: dict, true: dict) -> dict[str, Any]:
    """Precision, recall and F1 of path sets, with the sorted common, missing and extra paths."""
    a, b = set(pred), set(true)
    common = a & b
    p = len(common) / len(a) if a else float(not b)
    r = len(common) / len(b) if b else float(not a)
    f = 2 * p * r / (p + r) if p + r else 0.0
    return {"P": round(p, 3), "R": round(r, 3), "F1": round(f, 3), "common": sorted(common), "missing": sorted(b - a), "extra": sorted(a - b)}


_CLOSERS = re.compile(r'\s*(?:[,}\]:]|$)')


def escape_inner_quotes(text: str) -> str:
    """Escapes quotes inside JSON string literals: a quote ends its literal only before , } ] : or the end."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            closes = inside and (m := _CLOSERS.match(text, i + 1)) and (m.end() < len(text) or text[i + 1 :].strip() != "")
            if not inside or closes:
                inside = not inside
            else:
                c = '\\"'
        out.append(c)
        i += 1
    return "".join(out)


def json_of_message(message: str, default: dict | None = None) -> Any:
    """The object in a model's answer: after the last ```json fence, from the first { to the last }."""
    default = {} if default is None else default
    body = message.strip()
    if "```json\n" in message:
        body = message[message.rfind("```json\n") + 8 :]
    elif message.startswith("json\n"):
        body = body[4:]
    elif "```json" in message:
        body = message[message.find("```json") + 7 :]
    first, last = body.find("{"), body.rfind("}")
    if first < 0 or last <= first or len(body) <= 2:
        return default
    body = body[first : last + 1]
    for candidate in (body, escape_inner_quotes(body)):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return default


def safe_object(text: str | None) -> dict:
    """Fences stripped, outer braces as a fallback; anything but an object is {}."""
    body = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "")
    inner = body[body.find("{") : body.rfind("}") + 1] if "{" in body else ""
    for candidate in (body, inner):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return {}


def resolve_embedded(value: Any) -> Any:
    """Strings that hold JSON objects or arrays, parsed, at any depth."""
    if isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            parsed = json.loads(value.strip())
        except ValueError:
            return value
        return resolve_embedded(parsed) if isinstance(parsed, (dict, list)) else value
    if isinstance(value, dict):
        return {k: resolve_embedded(v) for k, v in value.items()}
    return [resolve_embedded(v) for v in value] if isinstance(value, list) else value


# --- text forms -------------------------------------------------------------


def normalise_symbols(text: str) -> str:
    """One line, single spaces, all quotes alike, lower case."""
    return re.sub(r" +", " ", re.sub(r"[\r\n]+", " ", text.strip())).translate({0x201C: '"', 0x201D: '"', 0x27: '"'}).lower()


def squeeze(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" +", " ", text)).strip()


def scalar(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return ("falso", "verdadeiro")[value]
    return squeeze(value) if isinstance(value, str) else str(value)


def _plain(value: Any) -> bool:
    return not isinstance(value, (dict, list))


def _markdown_lines(value: Any, level: int) -> list[str]:
    head = lambda name: f"{'#' * min(6, level + 1)} {str(name).strip()}"
    if _plain(value):
        return [f"\n{scalar(value)}\n"]
    lines: list[str] = []
    if isinstance(value, dict):
        for k, v in value.items():
            lines += [head(k), "\n".join(_markdown_lines(v, level + 1))]
        return lines
    for i, item in enumerate(value, 1):
        lines += [f"{i}. {scalar(item)}"] if _plain(item) else [head(i), "\n".join(_markdown_lines(item, level + 1))]
    return lines


def markdown(data: dict, level: int = 1) -> str:
    """Headings by depth, numbered scalars."""
    parts = [line for k, v in data.items() for line in (f"{'#' * level} {str(k).strip()}", "\n".join(_markdown_lines(v, level)))]
    return squeeze("\n".join(parts))


def _inline(value: Any) -> str:
    """A nested value without marks, on one line."""
    if _plain(value):
        return scalar(value)
    lines = (re.sub(r"^#+\s*", "", x.strip()) for x in "\n".join(_markdown_lines(value, 1)).splitlines())
    return " ".join(x.strip() for x in lines if x.strip())


def linear(data: dict) -> str:
    """"key: value." with "; " between the parts of lists and objects."""
    out = []
    for k, v in data.items():
        parts = [f"{str(kk).strip()}: {_inline(vv)}" for kk, vv in v.items()] if isinstance(v, dict) else [_inline(x) for x in v] if isinstance(v, list) else [scalar(v)]
        out.append(f"{str(k).strip()}: {'; '.join(parts)}.")
    return squeeze(" ".join(out))


def _sentence(name: str, value: Any) -> str:
    if _plain(value):
        return f"{name} é {scalar(value)}."
    if not value:
        return f"{name} está vazio."
    if isinstance(value, dict):
        return " ".join(_sentence(f"{name} {str(k).strip()}", v) for k, v in value.items())
    if all(map(_plain, value)):
        texts = [scalar(x) for x in value]
        joined = texts[0] if len(texts) == 1 else f"{', '.join(texts[:-1])} e {texts[-1]}"
        return f"{name} contém {joined}."
    parts = [f"{name} contém {len(value)} itens.\n"]
    for i, item in enumerate(value, 1):
        if item is None:
            parts.append(f"Item {i} está vazio.")
        elif isinstance(item, dict):
            parts += [_sentence(f"No item {i} {str(k).strip()}", v) + "\n" for k, v in item.items()]
        else:
            parts.append(f"Item {i} é {_inline(item)}.")
    return " ".join(parts)


def natural(data: dict) -> str:
    """Portuguese sentences, a paragraph per key."""
    return squeeze("\n\n".join(_sentence(str(k).strip(), v) for k, v in data.items()))


def _sorted_keys(value: Any) -> Any:
    return json.loads(json.dumps(value, sort_keys=True, ensure_ascii=False))


def value_text(value: Any, metric: str, symbols: bool = True) -> str:
    """The text of a value for a metric; error objects are empty."""
    if isinstance(value, dict) and "erro" in value:
        return ""
    if isinstance(value, str):
        parsed = resolve_embedded(value)
        if isinstance(parsed, str):
            return normalise_symbols(value) if symbols else value
        value = parsed
    if _plain(value):
        text = "" if value is None else str(value)
        return normalise_symbols(text) if symbols else text
    value = resolve_embedded(_sorted_keys(value))
    whole = value if isinstance(value, dict) else {"_valor": value}
    return linear(whole) if metric == "bertscore" else natural(whole)


def _item_text(item: Any) -> str:
    return natural(item) if isinstance(item, dict) else str(item)


def pair_text(true: Any, pred: Any, metric: str, aligned: bool = True) -> tuple[str, str]:
    """Texts of a gold and a predicted value; lists with objects on either side are aligned first."""
    if aligned and isinstance(true, list) and isinstance(pred, list) and true and pred and any(not _plain(x) for x in true + pred):
        # objects are compared in their serialised form, with sorted keys
        serial = lambda xs: [json.dumps(x, sort_keys=True, ensure_ascii=False) if isinstance(x, dict) else x for x in xs]
        pred, true = align(serial(pred), serial(true), _item_text)
    return value_text(true, metric), value_text(pred, metric)
