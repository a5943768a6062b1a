"""Caption tracks: cues to speaker turns to paragraphs."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from ..functions.entities import decode_entities, decode_text
from .lines import WS, escape_inline, heading, join_blocks, squash

#: Seconds of silence and characters that end a paragraph, least repeated overlap, shapes of markers.
GAP, SOFT, OVERLAP = 2.5, 700, 12
BARE = re.compile(r"([^:\n]{1,40}):[ \t]+(?=\S)")
_TIME = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})"
TIMING = re.compile(rf"^\s*{_TIME}\s*-->\s*{_TIME}", re.A)
ENDS = re.compile("[.!?…][\"'”’)\\]]*\\s*$")


@dataclass
class Turn:
    start: float
    end: float
    speaker: str | None
    forced: bool
    text: str


def seconds(parts) -> float:
    h, m, s, ms = parts
    return int(h or 0) * 3600 + int(m) * 60 + int(s) + int(ms.ljust(3, "0")) / 1000


def recurring_speakers(text: str) -> set[str]:
    seen = Counter(m[1].strip(WS) for line in re.split(r"\r\n|\r|\n", text) if "-->" not in line and (m := BARE.match(line)))
    return {name for name, n in seen.items() if n >= 2 and name}


def spans(source: str) -> list[list]:
    """[speaker, bold, italic, text] runs of a cue's text."""
    source = re.sub(r"\{\\[^}]*\}", "", source)
    out, bold, italic, voice = [], 0, 0, None
    for piece in re.split(r"(</?[A-Za-z0-9][^<>]*>)", source):
        m = re.fullmatch(r"<(/?)([A-Za-z0-9:.]+)([^<>]*)>", piece)
        if not m:
            if piece:
                out.append([voice, bold > 0, italic > 0, decode_entities(piece)])
            continue
        name, step = m[2].split(".")[0].lower(), -1 if m[1] else 1
        if name in ("i", "em"):
            italic = max(0, italic + step)
        elif name in ("b", "strong"):
            bold = max(0, bold + step)
        elif name == "v":
            voice = None if m[1] else decode_entities(m[3]).strip(WS) or "Unknown"
    return out


def shown(runs: list[list]) -> str:
    merged: list[list] = []
    for _, b, i, t in runs:
        if merged and merged[-1][:2] == [b, i]:
            merged[-1][2] += t
        else:
            merged.append([b, i, t])
    out = []
    for b, i, t in merged:
        mark = ("**" if b else "") + ("*" if i else "")
        core = t.strip(WS)
        out.append(escape_inline(t) if not mark or not core else t[: t.index(core)] + mark + escape_inline(core) + mark[::-1] + t[t.index(core) + len(core) :])
    return squash("".join(out))


def cue_turns(lines: list[str], recurring: set[str], start: float, end: float, named: str | None) -> list[Turn]:
    out: list[tuple[str | None, bool, list]] = []
    for k, line in enumerate(lines):
        speaker, forced, rest, marked = None, False, line, False
        text = re.sub(r"^(?:<[^<>]*>)+", "", line) if not line.lstrip().lower().startswith("<v") else line
        if m := re.match(r"\s*(?:>>|&gt;&gt;){1}(?:>|&gt;)?\s*(?:([^:<>]{1,40}):\s+)?", text):
            speaker, forced, rest, marked = (m[1] or "").strip(WS) or None, True, text[m.end() :], True
        elif m := re.match(r"\s*[-–—]\s+", text):
            forced, rest, marked = True, text[m.end() :], True
        elif (m := BARE.match(text)) and m[1].strip(WS) in recurring:
            speaker, rest, marked = m[1].strip(WS), text[m.end() :], True
        runs = spans(rest)
        for j, run in enumerate(runs):
            who = run[0] or speaker
            if not out or (marked and j == 0) or (run[0] and run[0] != out[-1][0]):
                out.append((who, forced and j == 0, [run]))
            else:
                if j == 0 and k:
                    out[-1][2].append([None, run[1], run[2], " "])
                out[-1][2].append(run)
    turns = [Turn(start, end, who, forced, shown(runs)) for who, forced, runs in out]
    if named and not any(t.speaker for t in turns):
        turns = [Turn(t.start, t.end, named, t.forced, t.text) for t in turns]
    return [t for t in turns if t.text]


def parse_track(text: str) -> dict:
    text = re.sub(r"\r\n|\r", "\n", text)
    recurring = recurring_speakers(text)
    track = {"turns": [], "cues": 0, "notes": 0, "styles": 0, "malformed": [], "title": None, "language": None, "chapters": False}
    for k, block in enumerate(b for b in re.split(r"\n[ \t]*\n", text) if b.strip(WS)):
        lines = block.strip("\n").split("\n")
        if k == 0 and lines[0].startswith("WEBVTT"):
            track["title"] = re.sub(r"^[\s-]+", "", lines[0][6:]).strip(WS) or None
            for line in lines[1:]:
                m = re.match(r"(Language|Kind)\s*:\s*(.*)", line, re.I)
                if m and m[1].lower() == "language":
                    track["language"] = m[2].strip(WS)
                elif m:
                    track["chapters"] = m[2].strip(WS).lower() == "chapters"
            if not any(TIMING.match(x) for x in lines):
                continue
        if re.match(r"NOTE\b", lines[0]):
            track["notes"] += 1
            continue
        if re.match(r"(STYLE|REGION)\b", lines[0]):
            track["styles"] += 1
            continue
        at = next((j for j, x in enumerate(lines) if "-->" in x), None)
        m = TIMING.match(lines[at]) if at is not None else None
        track["cues"] += at is not None
        if not m or seconds(m.groups()[4:]) < seconds(m.groups()[:4]):
            track["malformed"].append(lines[at if at is not None else 0])
            continue
        named = next((n[1].strip(WS) for x in lines[:at] if (n := re.match(r'.*"([^"]+)"\s*\(\d+\)\s*$', x))), None)
        track["turns"] += cue_turns(lines[at + 1 :], recurring, seconds(m.groups()[:4]), seconds(m.groups()[4:]), named)
    track["turns"].sort(key=lambda t: t.start)
    return track


def appended(said: str, more: str) -> str:
    """``more`` after ``said`` without a part that repeats its end, at word bounds."""
    bound = lambda s, k: k == 0 or k >= len(s) or s[k - 1].isspace() or s[k].isspace()
    if said.endswith(more) and bound(said, len(said) - len(more)):
        return said
    for n in range(min(len(said), len(more)), OVERLAP - 1, -1):
        if said.endswith(more[:n]) and bound(said, len(said) - n) and bound(more, n):
            rest = more[n:].strip(WS)
            return f"{said} {rest}" if rest else said
    return f"{said} {more}" if said else more


def paragraphs(turns: list[Turn]) -> list[dict]:
    out: list[dict] = []
    for t in turns:
        p = out[-1] if out else None
        if p is None or t.forced or t.speaker != p["speaker"] or t.start - p["end"] > GAP or (len(p["text"]) >= SOFT and ENDS.search(p["text"])):
            out.append({"start": t.start, "end": t.end, "speaker": t.speaker, "text": t.text})
        else:
            p["text"], p["end"] = appended(p["text"], t.text), max(p["end"], t.end)
    return out


def clock(s: float, hours: bool) -> str:
    n = int(s)
    return f"{n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}" if hours or n >= 3600 else f"{n // 60:02d}:{n % 60:02d}"


def read_subtitles(data: bytes) -> dict:
    track = parse_track(decode_text(data))
    if not track["cues"] and not track["malformed"]:
        raise ValueError("the track holds no cues")
    last = max((t.end for t in track["turns"]), default=0)
    out = [heading(1, escape_inline(track["title"])), ""] if track["title"] else []
    for p in paragraphs(track["turns"]):
        at = clock(p["start"], last >= 3600)
        if track["chapters"]:
            out += ["", f"## {at} {p['text']}", ""]
        else:
            out += [f"**{at}" + (f" {escape_inline(p['speaker'])}:" if p["speaker"] else "") + f"** {p['text']}", ""]
    warnings = []
    if track["malformed"]:
        bad = [x if len(x) <= 60 else x[:60] + "…" for x in track["malformed"]]
        warnings.append("Blocks without a readable time: " + "; ".join(bad[:8]) + ("…" if len(bad) > 8 else ""))
    if track["notes"]:
        warnings.append(f"{track['notes']} comment block(s) left out")
    if track["styles"]:
        warnings.append(f"{track['styles']} style or region block(s) left out")
    speakers = list(dict.fromkeys(t.speaker for t in track["turns"] if t.speaker))
    front = [("cues_converted", f"{track['cues'] - len(track['malformed'])}/{track['cues']}"), ("duration", clock(last, True) if last > 0 else ""), ("language", track["language"]), ("speakers", ", ".join(speakers))]
    return {"markdown": join_blocks(out), "warnings": warnings, "frontmatter": [(k, v) for k, v in front if v]}
