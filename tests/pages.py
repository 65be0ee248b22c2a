"""A stand-in for the REST service: one reading a minute."""

from datetime import datetime, timezone


def fetch(device_id, start, to, limit):
    times = range((to - 1) // 60_000 * 60_000, start - 1, -60_000)
    stamp = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    return {"data": [{"timestamp": stamp(t), "sensors": [{"comp": "temp", "value": float(device_id)}]} for t in list(times)[:limit]]}


def shaky(device_id, start, to, limit):
    """Two hours back an error, then two pages, then a rate limit."""
    from tidemark.sources.rest import HttpError

    hour = 3_600_000
    if 3 * hour < to < 4 * hour:
        raise HttpError(500)
    if to < hour:
        raise HttpError(429)
    return fetch(device_id, start, to, limit)
