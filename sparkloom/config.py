"""Settings of a program: defaults, a file over them, and what follows from them."""

from __future__ import annotations

import json
import logging
from functools import lru_cache

from .functions.catalog import catalog

DEFAULTS = {"format": "%(asctime)s %(levelname)s %(name)s: %(message)s", "level": "INFO", "prefixes": {}}


@lru_cache(8)
def settings(path: str | None = None) -> dict:
    """The defaults, overridden by a JSON or YAML file."""
    out = dict(DEFAULTS)
    if path:
        with open(path) as f:
            if path.endswith(".json"):
                out.update(json.load(f))
            else:
                import yaml

                out.update(yaml.safe_load(f) or {})
    return out


def jsonld_context(path: str | None = None) -> dict[str, str]:
    """Prefix to IRI: the model's, and those of the settings over them."""
    return {**catalog().prefixes, **settings(path)["prefixes"]}


def logger(name: str = "sparkloom", path: str | None = None) -> logging.Logger:
    """A logger with the settings' format and level."""
    s, log = settings(path), logging.getLogger(name)
    if not log.handlers:
        h = logging.StreamHandler()
        h.setFormatter(logging.Formatter(s["format"]))
        log.addHandler(h)
    log.setLevel(s["level"])
    return log
