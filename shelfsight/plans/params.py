"""Run parameters of the inventory job, validated up front.

The reference asks for them on the console; here they are job parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

# fixed values: which store a distribution report belongs to, by a word in
# its file name, and the two analysis windows (start -> end, first month of
# the late period).
REPORT_STORES = (("Arrivals", "NZDF.AKL109"), ("Departures", "NZDF.AKL108"))
WINDOWS = {
    "2019-04-01": ("2019-10-01", "2019-07-01"),
    "2019-06-01": ("2019-12-01", "2019-09-01"),
}


@dataclass(frozen=True)
class InventoryParams:
    store: str
    begin: str
    end: str
    split: str  # first day of the first late month

    @property
    def split_month(self) -> int:
        return int(self.split[5:7])


def store_for_report(report_path: str) -> str:
    for word, store in REPORT_STORES:
        if word in report_path:
            return store
    raise ValueError("distribution report name must contain 'Departures' or 'Arrivals'")


def inventory_params(report_path: str, start_date: str) -> InventoryParams:
    store = store_for_report(report_path)
    if start_date not in WINDOWS:
        raise ValueError(f"start date must be one of {sorted(WINDOWS)}")
    end, split = WINDOWS[start_date]
    return InventoryParams(store=store, begin=start_date, end=end, split=split)
