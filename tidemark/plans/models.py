"""Stand-ins for external models.  Python workers import this module alone, so it imports nothing of the package."""
from __future__ import annotations

import json

import pandas as pd


def stub_model(keys):
    """Deterministic stand-in for an external model: answers every key except CONF* (empty)."""
    kw = keys.map(lambda k: "" if k.startswith("CONF") else f"KW-{k.upper()}")
    wn = keys.map(lambda k: "" if k.startswith("CONF") else f"check {k}")
    return pd.DataFrame({"keyword": kw, "warning": wn})


def failing_model(keys):
    """A stand-in whose call fails whenever a key that starts with CONF is among its keys."""
    bad = sorted(k for k in keys if k.startswith("CONF"))
    if bad:
        raise ValueError(f"no answer for {bad[0]}")
    return pd.DataFrame({"keyword": "KW-" + keys.str.upper(), "warning": "check " + keys})


def text_model(texts):
    """Deterministic stand-in for a model that reads whole texts."""
    return [json.dumps({"guides": [{"standard_id": "", "title": f"T{len(t)}", "keywords": "k"}, {"standard_id": "S", "title": "", "keywords": None}],
                        "summary": f"S{len(t)}", "cause": "c"}) for t in texts]
