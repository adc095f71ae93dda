"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Sequence
from pathlib import Path


def config_of(module_file: str, path: str | None = None) -> dict:
    """The settings in ``path``, a JSON file beside the driver, over those of the config file named like the module."""
    default = json.loads(Path(module_file).with_suffix(".json").read_text())
    own = json.loads(Path(path).read_text()) if path else {}
    unknown = set(own) - set(default)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return default | own


def arguments(description: str, names: dict[str, str], argv: Sequence[str] | None) -> argparse.Namespace:
    """Required path arguments by name and meaning, and --config and --master."""
    parser = argparse.ArgumentParser(description=description)
    for name, meaning in names.items():
        parser.add_argument(f"--{name}", required=True, help=meaning)
    parser.add_argument("--config", help="a JSON file; what it leaves out is taken from the config file beside the job")
    parser.add_argument("--master", help="Spark's master, if spark-submit does not name it")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return parser.parse_args(argv)
