"""A table function for the neighbours of an agent in a network."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def coin(seed: int, net: int, a: int, b: int) -> bool:
    """Whether a pair of a random network is tied: eight hex digits of an MD5 of its key."""
    return int(hashlib.md5(f"{seed}|{net}|{min(a, b)}|{max(a, b)}".encode()).hexdigest()[:8], 16) < 1 << 31


class Neighbors:
    """neighbors(topology, net, i, n): a row for each neighbour of agent i of n. ring: the two beside it (twice the same one of two);
    star: agent 0 and the others; mesh: all others; random: by a coin for each pair, and an agent whom no coin ties is tied to
    the next. Fewer than two agents, nulls and other names have no neighbours."""

    def eval(self, topology: str, net: int, i: int, n: int):
        if topology is None or net is None or i is None or n is None or n < 2:
            return
        if topology == "ring":
            yield ((i - 1) % n,)
            yield ((i + 1) % n,)
        elif topology == "star":
            for j in range(1, n) if i == 0 else (0,):
                yield (j,)
        elif topology in ("mesh", "random"):
            others = [j for j in range(n) if j != i]
            if topology == "random":
                tied = {j for j in others if coin(3, net, i, j)}
                last = (i - 1) % n
                if not tied:
                    tied = {(i + 1) % n}
                if not any(coin(3, net, last, j) for j in range(n) if j != last):
                    tied.add(last)
                others = sorted(tied)
            for j in others:
                yield (j,)


def register(spark: SparkSession) -> None:
    """Makes neighbors() known to the session's SQL, for lateral joins."""
    spark.udtf.register("neighbors", udtf(Neighbors, returnType="dst bigint"))
