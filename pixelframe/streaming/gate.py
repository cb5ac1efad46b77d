"""The stability gate on a live epoch log."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.monitor import PATIENCE, STABLE_IOU

OUTPUT = "run_id long, gate_epoch int"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


PART = 1024  # epochs of one entry of the state


class Gate(StatefulProcessor):
    """State of a run: two bits per epoch while the gate is shut, in entries of PART epochs, one number after.

    A call to the store costs far more than an epoch: a micro-batch makes two per entry it touches.
    """

    def __init__(self, threshold: float, patience: int, horizon: int | None):
        self.threshold, self.patience, self.horizon = threshold, patience, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.gate = handle.getValueState("gate", "gate_epoch int")
        self.epochs = handle.getMapState("epochs", "part int", "known binary, good binary")
        self.latest = handle.getValueState("latest", "epoch int")

    def entry(self, part: int) -> list[int]:
        """Bits of known and of good epochs of an entry, read once per micro-batch."""
        if part not in self.read:
            stored = self.epochs.getValue((part,))
            self.read[part] = [int.from_bytes(b, "little") for b in stored] if stored is not None else [0, 0]
        return self.read[part]

    def good(self, epoch: int) -> bool:
        return epoch >= self.oldest and bool(self.entry(epoch // PART)[1] >> epoch % PART & 1)

    def learn(self, epoch: int, flag: bool) -> bool:
        """Take in an epoch; whether it was new."""
        entry, bit = self.entry(epoch // PART), 1 << epoch % PART
        if entry[0] & bit:
            return False
        entry[0] |= bit
        entry[1] |= bit * flag
        return True

    def opened_by(self, epoch: int) -> int | None:
        """Last epoch of the first `patience` good ones in a row that hold this one."""
        start = epoch
        while start > epoch - self.patience + 1 and self.good(start - 1):
            start -= 1
        end = epoch
        while end < start + self.patience - 1 and self.good(end + 1):
            end += 1
        return end if end - start == self.patience - 1 else None

    def move_on(self, newest: int) -> int:
        """Forget entries beyond the horizon; returns the oldest epoch that still counts."""
        if self.horizon is None:
            return -(1 << 31)
        before = self.latest.get()[0] if self.latest.exists() else newest
        latest = max(before, newest)
        first = (latest - self.horizon) // PART
        if first > (before - self.horizon) // PART:
            for (part,) in list(self.epochs.keys()):  # no more than the horizon holds
                if part < first:
                    self.epochs.removeKey((part,))
        self.latest.update((latest,))
        return latest - self.horizon

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[int, bool] = {}
        for frame in rows:
            for epoch, flag in zip(frame["epoch"].tolist(), (frame["iou"] >= self.threshold).tolist()):
                fresh[epoch] = fresh.get(epoch, True) and flag
        if self.gate.exists():
            return
        self.read: dict[int, list[int]] = {}
        self.oldest = self.move_on(max(fresh))
        new = [(e, flag) for e, flag in fresh.items() if e >= self.oldest and self.learn(e, flag)]
        ends = [end for e, flag in new if flag and (end := self.opened_by(e)) is not None]
        if ends:
            gate = min(ends) + 1
            self.gate.update((gate,))
            self.epochs.clear()
            self.latest.clear()
            yield pd.DataFrame({"run_id": [key[0]], "gate_epoch": [gate]})
            return
        for part in {e // PART for e, _ in new}:
            bits = tuple(b.to_bytes(PART // 8, "little") for b in self.read[part])
            self.epochs.updateValue((part,), bits)

    def close(self) -> None:
        pass


def stream_gate(
    epoch_log: DataFrame,
    threshold: float = STABLE_IOU,
    patience: int = PATIENCE,
    horizon: int | None = None,
) -> DataFrame:
    """One row per run when its gate opens; `epoch_log(run_id, epoch, iou)` is a stream.

    Epochs may arrive in any order and in any micro-batch. The gate is the first that the epochs
    known then give. Of an epoch that comes again in a later micro-batch the first counts, within
    one the least; a null `iou` is not good, rows without run or epoch are left out. A micro-batch
    reads and writes the entries of its own epochs and of `patience` around each, whatever the run
    has logged before. With `horizon` an epoch counts only while it is at most that far below the
    greatest epoch of its run; state is then bounded for runs whose gate never opens.

    State is kept in RocksDB, which this sets for the session's later streams.
    """
    epoch_log.sparkSession.conf.set(STORE, ROCKSDB)
    rows = epoch_log.select("run_id", "epoch", "iou").dropna(subset=["run_id", "epoch"])
    return rows.groupBy("run_id").transformWithStateInPandas(
        Gate(threshold, patience, horizon), OUTPUT, "Append", "None"
    )
