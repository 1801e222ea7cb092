"""A corpus in shards: each on its own, those that are done are passed over, and one that fails stops no other.

The ledger is a folder beside the store with a small file a shard: what it gave, or how it failed. A run works off the
shards that the ledger does not have as done; as ids are deterministic, a shard whose run was cut short between its
last write and its entry is done again without a second copy.
"""

from __future__ import annotations

import json
import time

from clauseworks.functions.text import shard_count
from clauseworks.plans import index
from clauseworks.plans.engine import Engine
from clauseworks.sources import corpus

LEDGER = "ledger"
DONE, FAILED = "done", "failed"


def _put(engine: Engine, entry: dict) -> None:
    fs, at = index._fs(engine.spark, f"{engine.storage}/{LEDGER}/{entry['shard']:06d}.json")
    out = fs.create(at, True)
    out.write(bytearray(json.dumps(entry, ensure_ascii=False).encode()))
    out.close()


def ledger(engine: Engine) -> dict[int, dict]:
    """The entry of each shard that was begun; there are as many as shards: tens."""
    folder = f"{engine.storage}/{LEDGER}"
    if not index._listed(engine.spark, folder):
        return {}
    rows = engine.spark.read.text(f"{folder}/*.json", wholetext=True).collect()
    return {e["shard"]: e for e in (json.loads(r[0]) for r in rows)}


def ingest(engine: Engine, corpus_dir: str, size: int, cache_path: str | None = None) -> dict:
    """Ingests all shards of ``size`` documents of record that are not done yet, and reports on all.

    Shards of another size than the ledger's are other shards, so the ledger is begun anew.
    """
    known = {n: e for n, e in ledger(engine).items() if e["size"] == size}
    for number in range(shard_count(corpus.read_index(engine.spark, corpus_dir).count(), size)):
        if known.get(number, {}).get("status") == DONE:
            continue
        began = time.time()
        try:
            entry = {"status": DONE, **engine.ingest(corpus_dir, cache_path, (number, size))}
        except Exception as e:  # whatever a shard fails of, the next ones go on
            entry = {"status": FAILED, "error": f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"}
        known[number] = {"shard": number, "size": size, "seconds": round(time.time() - began, 1), **entry}
        _put(engine, known[number])
    done = [e for e in known.values() if e["status"] == DONE]
    return {
        "shards": len(known), "done": len(done), "provisions": sum(e["provisions"] for e in done), "acts": sum(e["acts"] for e in done),
        "failed": {n: e["error"] for n, e in sorted(known.items()) if e["status"] == FAILED},
    }
