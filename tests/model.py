"""Plain Python model of turns, sessions, windows and splits."""

from datetime import datetime, timezone


def parse(ts):
    try:
        t = datetime.fromisoformat((ts or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def turns(messages, gap=300, unknown=False):
    out, last = [], None
    for m in messages:
        if not m["content"].strip():
            continue
        ts = parse(m.get("timestamp"))
        author = m.get("author_id") or m.get("username") or m["participant"]
        place = (m.get("channel_id"), m.get("session_id"))
        joins = False
        if last is not None and (place, m["participant"], author) == last[1:]:
            before = last[0]
            joins = (ts - before).total_seconds() <= gap if ts and before else unknown and ts is None and before is None
        if joins:
            t = out[-1]
            t["content"] += "\n" + m["content"].strip()
            t["ids"].append(m["id"])
            t["end"] = ts
        else:
            out.append({"participant": m["participant"], "author": author, "content": m["content"].strip(), "ids": [m["id"]], "start": ts, "end": ts, "place": place})
        last = (ts, place, m["participant"], author)
    return out


def sessions(found, gap=1800):
    out = []
    for t in found:
        new = not out
        if out:
            p = out[-1][-1]
            new = t["place"] != p["place"] or (t["start"] is None) != (p["end"] is None)
            if t["start"] and p["end"] and (t["start"] - p["end"]).total_seconds() > gap:
                new = True
        if new:
            out.append([])
        out[-1].append(t)
    return out


def windows(session, w=6):
    out = []
    for i, t in enumerate(session):
        if t["participant"] == "target":
            h = session[max(0, i - w + 1) : i + 1]
            while h and h[0]["participant"] == "target":
                h = h[1:]
            if len(h) >= 2:
                out.append(h)
    return out
