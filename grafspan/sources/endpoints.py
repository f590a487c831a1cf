"""Inbound routes and outgoing calls, read from a unit's annotations and call sites: plain records in, plain records out."""

from __future__ import annotations

import re

from .. import vocabulary as V

_STRING = re.compile(r'"((?:\\.|[^"\\])*)"')
CLIENT_ANNOTATIONS = {"CodebaseHttpClient", "CodebaseHttpClients"}
PRODUCER_ANNOTATIONS = {"CodebaseProducer", "CodebaseProducers"}
ROUTE_ANNOTATIONS = {"CodebaseHttpRoute", "CodebaseHttpRoutes", "CodebaseAsyncRoute", "CodebaseAsyncRoutes"}
#: RestTemplate methods and their verbs; exchange takes its verb as an argument.
REST_VERBS = {"getForObject": "GET", "getForEntity": "GET", "headForHeaders": "HEAD", "postForObject": "POST", "postForEntity": "POST", "postForLocation": "POST", "put": "PUT", "patchForObject": "PATCH", "delete": "DELETE", "optionsForAllow": "OPTIONS", "exchange": "", "execute": ""}


def split_args(args: str) -> list[str]:
    """Top-level parts of an argument list."""
    out, depth, cur, quoted = [], 0, "", False
    for i, ch in enumerate(args):
        if ch == '"' and (i == 0 or args[i - 1] != "\\"):
            quoted = not quoted
        if not quoted and ch in "([{":
            depth += 1
        if not quoted and ch in ")]}":
            depth -= 1
        if ch == "," and depth == 0 and not quoted:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return out + ([cur.strip()] if cur.strip() else [])


def named(args: str) -> dict[str, str]:
    """Attributes of an annotation; a single value is ``value``."""
    out = {}
    for part in split_args(args):
        m = re.match(r"(\w+)\s*=\s*(?!=)(.*)", part, re.DOTALL)
        out[m[1] if m else "value"] = m[2] if m else part
    return out


def atoms(value: str) -> list[tuple[str, str, float, bool]]:
    """(text, strategy, confidence, resolved) of an attribute: literals, placeholders or constants; arrays are flattened."""
    value = value.strip()
    if value[:1] in "{[" and value[-1:] in "}]" or value.startswith("arrayOf("):
        inner = value[8:-1] if value.startswith("arrayOf(") else value[1:-1]
        return [a for part in split_args(inner) for a in atoms(part)]
    if (m := _STRING.fullmatch(value)) is not None:
        return [(m[1], "spel", 0.85, False)] if "${" in m[1] or "#{" in m[1] else [(m[1], "annotation", 1.0, True)]
    return [(value, "constant_ref", 0.7, False)] if value else []


def _anns(row: dict) -> list[tuple[str, dict[str, str]]]:
    return [(n, named(a)) for n, a in zip(row["annotations"], row["annotation_args"], strict=True)]


def _paths(attrs: dict[str, str]) -> list[tuple[str, str, float, bool]]:
    return atoms(attrs.get("path") or attrs.get("value") or "")


def join_paths(base: str, path: str) -> str:
    return "/" + "/".join(s for s in f"{base}/{path}".split("/") if s)


def merged(base: tuple | None, path: tuple | None) -> tuple[str, str, float, bool]:
    """A class's path atom and a method's: the weaker of their strategies decides."""
    parts = [p for p in (base, path) if p]
    if not parts:
        return "/", "annotation", 1.0, True
    weak = min(parts, key=lambda p: p[2])
    return join_paths(base[0] if base else "", path[0] if path else ""), weak[1], weak[2], all(p[3] for p in parts)


def _route(member: dict, kind: str, framework: str, **more) -> dict:  # noqa: ANN003
    blank = {"http_method": "", "path": "", "topic": "", "broker": "", "feign_name": "", "feign_url": "", "strategy": "annotation", "confidence": 1.0, "resolved": True, "source_layer": "builtin"}
    return {"member_fqn": member["fqn"], "kind": kind, "framework": framework, "start_line": member["start_line"], "end_line": member["end_line"]} | blank | more


def routes(types: dict[str, dict], members: list[dict]) -> list[dict]:
    """Inbound routes of methods: web mappings (paths times verbs), listeners, and in-source declarations, which win for their channel."""
    out = []
    for m in members:
        owner = types.get(m["type_fqn"])
        if owner is None or m["kind"] != "method":
            continue
        own, found = dict(_anns(owner)), []
        feign = own.get("FeignClient")
        reactive = any(t in ("Mono", "Flux", "ServerRequest", "ServerWebExchange") for t in m["param_types"])
        for name, attrs in _anns(m):
            if name in V.HTTP_MAPPINGS:
                if feign is not None:
                    continue
                verbs = [V.HTTP_MAPPINGS[name]] if V.HTTP_MAPPINGS[name] else re.findall(r"\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b", attrs.get("method", "")) or [""]
                for base in _paths(own.get("RequestMapping", {})) or [None]:
                    for path in _paths(attrs) or [None]:
                        p, s, c, r = merged(base, path)
                        found += [_route(m, "http_endpoint", "webflux" if reactive else "spring_mvc", http_method=v, path=p, strategy=s, confidence=c, resolved=r) for v in verbs]
            elif name in V.LISTENERS:
                kind, framework, broker = V.LISTENERS[name]
                topics = atoms(attrs.get("topics") or attrs.get("queues") or attrs.get("destination") or attrs.get("topicPattern") or attrs.get("value") or "")
                found += [_route(m, kind, framework, topic=t, broker=broker, strategy=s, confidence=c, resolved=r) for t, s, c, r in topics]
            elif name in ROUTE_ANNOTATIONS:
                text = ",".join(f"{k}={v}" for k, v in attrs.items())
                inner = [named(x) for x in re.findall(r"@Codebase(?:Http|Async)Route\s*\(((?:[^()]|\([^()]*\))*)\)", text)] or [attrs]
                for a in inner:
                    one = lambda key, a=a: next((x[0] for x in atoms(a.get(key, ""))), "")
                    if "Async" in name:
                        found.append(_route(m, "kafka_topic", "codebase", topic=one("topic") or one("value"), broker=one("broker") or "kafka", strategy="codebase_route", source_layer="codebase"))
                    else:
                        found.append(_route(m, "http_endpoint", "codebase", http_method=one("method") or a.get("method", "").rsplit(".", 1)[-1].strip('"'), path=join_paths("", one("path") or one("value")), strategy="codebase_route", source_layer="codebase"))
        for channel in ("http", "async"):
            is_http = lambda r, channel=channel: (r["kind"] == "http_endpoint") == (channel == "http")
            if any(is_http(r) and r["source_layer"] == "codebase" for r in found):
                found = [r for r in found if not is_http(r) or r["source_layer"] == "codebase"]
        out += found
    return out


def _outgoing(member_fqn: str, kind: str, channel: str, line: int, **more) -> dict:  # noqa: ANN003
    blank = {"feign_target_name": "", "feign_target_url": "", "path_template_call": "", "method_call": "", "topic_call": "", "broker_call": "", "raw_uri": "", "raw_topic": "", "strategy": "", "confidence": 1.0, "resolved": True, "source_layer": "builtin"}
    return {"member_fqn": member_fqn, "client_kind": kind, "channel": channel, "line": line} | blank | more


def _first_path(arg: str) -> tuple[str, float, bool]:
    """Path of a URI argument: a literal that begins with a slash; the last such literal of a sum; nothing for calls."""
    arg = arg.strip()
    if (m := _STRING.fullmatch(arg)) is not None:
        path = m[1] if m[1].startswith("/") else ""
        return path, 1.0 if path else 0.3, bool(path)
    if "+" in arg and (found := [s for s in _STRING.findall(arg) if s.startswith("/")]):
        return found[-1], 0.7, True
    return "", 0.3, False


def outgoing(types: dict[str, dict], members: list[dict], fields: list[dict], scope: list[dict], calls: list[dict]) -> list[dict]:
    """Outbound calls: methods of remote interfaces, RestTemplate, WebClient, KafkaTemplate and StreamBridge, and in-source declarations, which replace the rest of a method."""
    out, by_member = [], {m["fqn"]: m for m in members}
    variables: dict[str, dict[str, str]] = {}
    for m in members:
        own = {f["name"]: f["type"] for f in fields if f["type_fqn"] == m["type_fqn"]}
        variables[m["fqn"]] = own
    for s in sorted(scope, key=lambda s: (s["rank"], s["ordinal"])):
        if s["member_fqn"] in variables:
            variables[s["member_fqn"]] = variables[s["member_fqn"]] | {s["name"]: s["type"]}
    pinned = set()
    for m in members:
        owner = dict(_anns(types[m["type_fqn"]])) if m["type_fqn"] in types else {}
        if (feign := owner.get("FeignClient")) is not None and m["kind"] == "method":
            name = next((a[0] for k in ("name", "value") for a in atoms(feign.get(k, ""))), "")
            url = next((a[0] for a in atoms(feign.get("url", ""))), "")
            base = next((a[0] for a in atoms(feign.get("path", ""))), "")
            verb, path = "", ""
            for n, attrs in _anns(m):
                if n in V.HTTP_MAPPINGS:
                    verb = V.HTTP_MAPPINGS[n] or next(iter(re.findall(r"\b(GET|POST|PUT|DELETE|PATCH)\b", attrs.get("method", ""))), "")
                    path = next((a[0] for a in _paths(attrs)), "")
            full = join_paths(base, path) if base or path else ""
            out.append(_outgoing(m["fqn"], "feign_method", "http", m["start_line"], feign_target_name=name, feign_target_url=url, path_template_call=full, method_call=verb, raw_uri=full, strategy="feign"))
        for n, attrs in _anns(m):
            one = lambda key, attrs=attrs: next((x[0] for x in atoms(attrs.get(key, ""))), "")
            if n in CLIENT_ANNOTATIONS:
                pinned.add((m["fqn"], "http"))
                out.append(_outgoing(m["fqn"], "rest_template", "http", m["start_line"], feign_target_name=one("targetService"), path_template_call=one("path"), method_call=one("method") or attrs.get("method", "").rsplit(".", 1)[-1], raw_uri=one("path"), strategy="codebase_client", source_layer="codebase"))
            elif n in PRODUCER_ANNOTATIONS:
                pinned.add((m["fqn"], "async"))
                out.append(_outgoing(m["fqn"], "kafka_send", "async", m["start_line"], topic_call=one("topic"), broker_call=one("broker") or "kafka", raw_topic=one("topic"), strategy="codebase_producer", source_layer="codebase"))
    for c in calls:
        if c["caller_fqn"] not in by_member:
            continue
        kind = variables[c["caller_fqn"]].get(c["receiver"].removeprefix("this."), "")
        args = split_args(c["args"])
        if kind == "RestTemplate" and c["callee"] in REST_VERBS and (c["caller_fqn"], "http") not in pinned:
            verb = REST_VERBS[c["callee"]] or next(iter(re.findall(r"HttpMethod\.(\w+)", args[1] if len(args) > 1 else "")), "")
            path, confidence, resolved = _first_path(args[0] if args else "")
            out.append(_outgoing(c["caller_fqn"], "rest_template", "http", c["line"], path_template_call=path, method_call=verb, raw_uri=args[0] if args else "", strategy="rest_template", confidence=confidence, resolved=resolved))
        elif kind == "WebClient" and (c["caller_fqn"], "http") not in pinned:
            out.append(_outgoing(c["caller_fqn"], "web_client", "http", c["line"], raw_uri=c["args"], strategy="web_client", confidence=0.3, resolved=False))
        elif kind == "KafkaTemplate" and c["callee"] == "send" and (c["caller_fqn"], "async") not in pinned:
            topic = next(iter(atoms(args[0] if args else "")), ("", "constant_ref", 0.7, False))
            out.append(_outgoing(c["caller_fqn"], "kafka_send", "async", c["line"], topic_call=topic[0] if topic[3] else "", broker_call="kafka", raw_topic=topic[0], strategy=topic[1], confidence=topic[2], resolved=topic[3]))
        elif kind == "StreamBridge" and c["callee"] == "send" and (c["caller_fqn"], "async") not in pinned:
            out.append(_outgoing(c["caller_fqn"], "stream_bridge_send", "async", c["line"], broker_call="stream", raw_topic=args[0] if args else "", strategy="stream_bridge", confidence=0.3, resolved=False))
    return out
