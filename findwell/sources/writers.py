"""Search responses as text, one line per hit, or JSON."""

from __future__ import annotations

import json


def _short(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "..."


def _line(text: str) -> str:
    return text.replace("\n", " ").replace("\t", " ").strip()


def _notice(response: dict) -> str:
    said = response.get("suggestions") or []
    if response.get("auto_fuzzy"):
        return "Nothing holds these words; similar words were searched" + (f": {said[0]}" if said else "")
    return f"Perhaps you meant {' or '.join(said)}" if said else ""


def _head(response: dict) -> str:
    words, meaning = response["total_keyword"], response["total_semantic"]
    return f"{words + meaning} documents ({words} by words, {meaning} by meaning) after {response['query_time_ms']} ms"


def as_json(response: dict) -> str:
    return json.dumps(response, default=str, ensure_ascii=False, indent=2)


def as_lines(response: dict) -> str:
    """One line per hit: its list, rank, score and file, or title, or the begin of its content."""
    out = [_head(response), *filter(None, [_notice(response)])]
    for kind in ("keyword", "semantic"):
        for r in response[kind]:
            d = r["document"]
            name = (d.get("metadata") or {}).get("source_path") or _line(d.get("title") or "") or _short(_line(d.get("content") or ""), 80)
            out.append(f"{kind}\t{r['rank']}\t{r['score']:.4f}\t{name}")
    return "\n".join(out)


def as_text(response: dict) -> str:
    """Both lists, each hit with its scores, id, title and the begin of its content."""
    out = [_head(response), *filter(None, [_notice(response)])]
    for kind, title in (("keyword", "By words"), ("semantic", "By meaning")):
        out += ["", title] * bool(response[kind])
        for r in response[kind]:
            d = r["document"]
            out.append(f"{r['rank']:>4}. {d.get('title') or '(no title)'}  [{r['score']:.4f}; words {r['keyword_score']:.4f}, meaning {r['semantic_score']:.4f}]")
            out += [f"      {d['id']}", f"      {_short(_line(d.get('content') or ''), 200)}"]
    return "\n".join(out)


WRITERS = {"text": as_text, "compact": as_lines, "json": as_json}
