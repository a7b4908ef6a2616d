"""Parsers of transcript files: what one file or record says, as plain rows.

Each works on one file's bytes or one record, holds no state of other files,
and runs on executors; ordinals, roll-ups and merging are done on tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime

from ..functions.text import compact_json, cut_bytes, cut_runes

#: Longest line of a JSON-lines file, in bytes; longer ones are skipped.
LONGEST_LINE = 16 << 20
RESULT_MOST, CALL_MOST, ARGS_MOST, SUMMARY_MOST = 4096, 1024, 512, 4096
# What a user text begins with if it is none, and the blocks that a summary goes without.
NOT_SAID = ("<turn_aborted>",)
NOT_HISTORY = ("<permissions instructions>", "<turn_aborted>")


def unix_seconds(text) -> int:
    """Seconds of an RFC 3339 time, 0 for what is none."""
    if not isinstance(text, str) or not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)", text):
        return 0
    try:
        return int(datetime.fromisoformat(re.sub(r"\.\d+", "", text).replace("Z", "+00:00")).timestamp())
    except ValueError:
        return 0


def lines(data: bytes, offset: int = 0) -> Iterator[tuple[int, dict]]:
    """(byte offset, record) of whole, valid lines from ``offset``. A last line without its end is left for the next time."""
    at = offset
    while (end := data.find(b"\n", at)) >= 0:
        raw = data[at:end]
        if raw.strip() and len(raw) <= LONGEST_LINE and (record := record_of(raw)) is not None:
            yield at, record
        at = end + 1


def record_of(raw: bytes | None) -> dict | None:
    """The record of a line, or nothing; a line that is too long comes as none."""
    try:
        found = json.loads(raw) if raw is not None else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def bad_lines(data: bytes, offset: int = 0) -> int:
    """How many whole lines from ``offset`` say something that is no record, or are too long."""
    whole = [x for x in data[offset : consumed(data)].split(b"\n") if x.strip()]
    return len(whole) - sum(1 for _ in lines(data, offset))


def consumed(data: bytes) -> int:
    """The offset after the last whole line."""
    return data.rfind(b"\n") + 1


def _text(value) -> str:
    return value if isinstance(value, str) else ""


def _texts(parts, kinds: tuple[str, ...] | None = None) -> str:
    """The texts of a list of parts, one a line."""
    found = [_text(p.get("text")) for p in parts if isinstance(p, dict) and (kinds is None or p.get("type") in kinds)] if isinstance(parts, list) else []
    return "\n".join(t for t in found if t)


# -- format A: a session in a JSON-lines file; user and assistant records --


def _result_text(part: dict) -> str:
    body = part.get("content")
    body = body if isinstance(body, str) else _texts(body, ("text",))
    error = " error" if part.get("is_error") else ""
    ref = _text(part.get("tool_use_id"))[:12]
    return f"[tool_result{error}{f' id={ref}' if ref else ''}] {cut_runes(body, RESULT_MOST)}"


def _user_text(content) -> str:
    if isinstance(content, str):
        return content
    out = []
    for part in content if isinstance(content, list) else ():
        kind = part.get("type") if isinstance(part, dict) else None
        if kind == "text" and _text(part.get("text")).strip():
            out.append(part["text"].strip())
        elif kind == "tool_result":
            out.append(_result_text(part))
    return "\n".join(out)


def _assistant_texts(content) -> tuple[str, str]:
    """What an assistant record says, tool calls included, and what it thinks. Content that is a plain string says nothing."""
    said, thought = [], []
    for part in content if isinstance(content, list) else ():
        kind = part.get("type") if isinstance(part, dict) else None
        if kind == "text" and _text(part.get("text")).strip():
            said.append(part["text"].strip())
        elif kind == "thinking" and _text(part.get("thinking")).strip():
            thought.append(part["thinking"].strip())
        elif kind == "tool_use":
            args = compact_json(part["input"]) if part.get("input") is not None else ""
            said.append(f"[tool_use name={_text(part.get('name'))}] {cut_runes(args, CALL_MOST)}".rstrip())
    return "\n".join(said), "\n".join(thought)


#: What a line says of its whole file (``uid, workspace, started``), and its messages (``role, ts, content, sub``, for some formats with a session).
Line = tuple[tuple[str, str, int], list[dict]]
NOTHING = ("", "", 0)


def session_line(record: dict) -> Line:
    """A line of a format A file; the session's id and folder are the first that any line of the file names."""
    head = (_text(record.get("sessionId")), _text(record.get("cwd")), 0)
    message = record.get("message")
    if not isinstance(message, dict):
        return head, []
    if record.get("type") == "user":
        found = [("user", _user_text(message.get("content")))]
    elif record.get("type") == "assistant":
        found = list(zip(("assistant", "thinking"), _assistant_texts(message.get("content")), strict=True))
    else:
        return head, []
    ts = unix_seconds(record.get("timestamp")) or None
    return head, [{"role": role, "ts": ts, "content": text, "sub": sub} for sub, (role, text) in enumerate(found) if text.strip()]


def _whole(data: bytes, offset: int, line) -> tuple[list, list[dict]]:
    """What all lines say of the file, and the messages from ``offset``."""
    head, rows = list(NOTHING), []
    for at, record in lines(data):
        said, found = line(record)
        head = [h or s for h, s in zip(head, said, strict=True)]
        if at >= offset:
            rows += [r | {"source_offset": at} for r in found]
    return head, rows


def session_file(path: str, data: bytes, offset: int = 0) -> Iterator[dict]:
    """Message rows of a format A file: ``session_uid, workspace, role, ts, content, source_offset, sub``; the head is looked for from the start."""
    (uid, workspace, _), rows = _whole(data, offset, session_line)
    uid = uid or path.rsplit("/", 1)[-1].removesuffix(".jsonl")
    return ({"session_uid": uid, "workspace": workspace, "started_at": None} | r for r in rows)


# -- format B: a rollout of payloads in a JSON-lines file, and a history shared by sessions --


def _payload_message(payload: dict) -> tuple[str, str] | None:
    kind = payload.get("type")
    if kind == "message" and payload.get("role") in ("user", "assistant"):
        text = _texts(payload.get("content"))
        if payload["role"] == "user" and text.lstrip().startswith(NOT_SAID):
            return None
        return payload["role"], text
    if kind == "reasoning":
        return "thinking", "\n".join(t for t in (_texts(payload.get("summary")), _texts(payload.get("content"))) if t)
    if kind == "function_call":
        return "tool", f"[tool_call name={_text(payload.get('name'))}] {cut_bytes(_text(payload.get('arguments')), CALL_MOST)}"
    if kind == "function_call_output":
        out = payload.get("output")
        return "tool", f"[tool_result] {cut_bytes(out if isinstance(out, str) else compact_json(out) if out is not None else '', RESULT_MOST)}"
    return None


def rollout_line(record: dict) -> Line:
    """A line of a format B file; ``started`` is what the session's own record says."""
    payload = record.get("payload")
    if not isinstance(payload, dict):
        return NOTHING, []
    ts = unix_seconds(record.get("timestamp"))
    if record.get("type") == "session_meta":
        return (_text(payload.get("id")), _text(payload.get("cwd")), unix_seconds(payload.get("timestamp")) or ts), []
    if record.get("type") == "response_item" and (found := _payload_message(payload)) and found[1].strip():
        return NOTHING, [{"role": found[0], "ts": ts or None, "content": found[1], "sub": 0}]
    return NOTHING, []


def rollout_file(path: str, data: bytes, offset: int = 0) -> Iterator[dict]:
    """Message rows of a format B file, as ``session_file``; none if it names no session."""
    (uid, workspace, started), rows = _whole(data, offset, rollout_line)
    return ({"session_uid": uid, "workspace": workspace, "started_at": started or None} | r for r in rows if uid)


def history_line(record: dict) -> Line:
    """A line of a shared history: a user message of a session of its own, if it says something."""
    text, ts = _text(record.get("text")), record.get("ts")
    if not _text(record.get("session_id")) or not text.strip() or text.lstrip().startswith(NOT_HISTORY):
        return NOTHING, []
    return NOTHING, [{"session_uid": record["session_id"], "role": "user", "ts": int(ts) if isinstance(ts, int | float) and ts else None, "content": text, "sub": 0}]


def history_file(path: str, data: bytes, offset: int = 0) -> Iterator[dict]:
    """Message rows of a shared history."""
    return ({"workspace": "", "started_at": None} | r for r in _whole(data, offset, history_line)[1])


# -- format C: key-value stores of composers and their bubbles --


def tool_summary(name: str, args: str) -> str:
    """A tool call in a line; empty without a name."""
    if not name:
        return ""
    args = cut_runes(args, ARGS_MOST)
    return f"[tool name={name} args={args}]" if args and args != "null" else f"[tool name={name}]"


def _json_of(record: dict, *keys: str) -> str:
    """The first of the keys that is there, as compact JSON."""
    return next((compact_json(record[k]) for k in keys if record.get(k) is not None), "")


def bubble_text(bubble: dict) -> str:
    """The first text that a bubble has, or else its tool call; rich text is not looked at."""
    for key in ("text", "content", "message"):
        if _text(bubble.get(key)).strip():
            return bubble[key].strip()
    data, calls = bubble.get("toolFormerData"), bubble.get("tool_calls")
    found = ""
    if isinstance(data, dict):
        found = tool_summary(_text(data.get("name")) or _text(data.get("tool")), _text(data.get("rawArgs")) or _json_of(data, "args", "arguments"))
    if not found and isinstance(calls, list) and calls and isinstance(calls[0], dict):
        call = calls[0]
        inner = call["function"] if not _text(call.get("name")) and isinstance(call.get("function"), dict) else {}
        found = tool_summary(_text(call.get("name")) or _text(inner.get("name")), _json_of(call, "arguments") or _json_of(inner, "arguments"))
    return found or tool_summary(_text(bubble.get("name")), _json_of(bubble, "arguments"))


# Blocks that a digest goes without, and tags whose inside stays.
_STRIPPED = ("previous_tool_call", "additional_data", "attached_files", "file_contents", "last_terminal_cwd")
_BARE_TAGS = re.compile(r"</?(?:user_query|user_message|assistant_message)>")
_SAID = {who: re.compile(rf"<previous_{tag}_message>(.*?)(?:</previous_{tag}_message>|\Z)", re.S) for who, tag in (("User", "user"), ("Assistant", "assistant"))}


def summary_digest(text: str) -> str:
    """A conversation summary without its preamble and inserted blocks: what users said, then what assistants said."""
    begin = text.find("<previous_user_message>")
    begin = begin if begin >= 0 else text.find("<previous_assistant_message>")
    text = text[max(0, begin) :]
    for tag in _STRIPPED:
        text = re.sub(rf"<{tag}>.*?</{tag}>", "", text, flags=re.S)
        text = re.sub(rf"[ \n\t]*<{tag}>.*", "", text, flags=re.S)
    inner = ((who, _BARE_TAGS.sub("", t).strip()) for who, rx in _SAID.items() for t in rx.findall(text))
    digest = "\n\n".join(f"{who}: {t}" for who, t in inner if t).replace("<omitted />", "…")
    return cut_runes(re.sub(r"\n{3,}", "\n\n", digest).strip(), SUMMARY_MOST)
