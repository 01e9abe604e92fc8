"""Command line: --version and --info."""

from __future__ import annotations

import argparse

from . import __version__


def print_version() -> None:
    print(f"tidalframe {__version__}")


def print_info() -> None:
    print_version()
    print("Time-series analytics on Spark DataFrames. Start with tidalframe.frame.panel and tidalframe.estimators.")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidalframe")
    parser.add_argument("--version", action="store_true")
    parser.add_argument("--info", action="store_true")
    own = parser.parse_args(args)
    if own.version:
        print_version()
    elif own.info:
        print_info()
    else:
        parser.print_help()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
