"""Fetchers for tests of the address source: answers instead of a network."""

import json
import os


def fake(address: str, timeout: float) -> bytes:
    """Sizes from the number in the address; every seventh image is missing."""
    n = int(address.split("/")[3])
    if n % 7 == 0:
        raise FileNotFoundError(address)
    return json.dumps({"height": n, "width": n + 1}).encode() if address.endswith("info.json") else f"image {n}".encode()


def flaky(address: str, timeout: float) -> bytes:
    """Fails the first two times for each address."""
    mark = os.path.join(os.environ["FETCH_DIR"], address.replace("/", "_"))
    n = os.path.getsize(mark) if os.path.exists(mark) else 0
    with open(mark, "a") as f:
        f.write("x")
    if n < 2:
        raise OSError("busy")
    return fake(address, timeout)
