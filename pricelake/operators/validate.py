"""Validity rules for asset names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Asset codes, contract ids, longest accepted asset list.
CODE = "^[A-Z0-9]{1,12}$"
CONTRACT = "^C[A-Z2-7]{55}$"
MAX_ASSETS = 50


def asset_valid(asset: Column, *, strict: bool = False) -> Column:
    """A short upper-case code, or a 56-character contract id starting with C."""
    contract = asset.rlike(CONTRACT) if strict else asset.startswith("C") & (F.length(asset) == 56)
    return F.coalesce(asset.rlike(CODE) | contract, F.lit(False))


def asset_list_valid(assets: Column) -> Column:
    """A list of 1 to 50 strictly valid assets."""
    return F.size(assets).between(1, MAX_ASSETS) & F.forall(assets, lambda a: asset_valid(a, strict=True))
