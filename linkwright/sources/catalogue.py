"""Where the public provider files are, and fetching them."""

from __future__ import annotations

import urllib.request
from dataclasses import dataclass
from pathlib import Path

_ROOT = "https://data.nber.org/npi"


@dataclass(frozen=True)
class CoreFile:
    year: int
    month: int
    format: str
    url: str


#: The latest provider core file of each year.
CORE_FILES = (
    CoreFile(2018, 12, "csv", f"{_ROOT}/2018/core201812.csv"),
    CoreFile(2019, 12, "parquet", f"{_ROOT}/2019/12/core_201912.parquet"),
    CoreFile(2020, 12, "parquet", f"{_ROOT}/2020/csv/core202012.parquet"),
    CoreFile(2021, 12, "parquet", f"{_ROOT}/2021/csv/core202112.parquet"),
    CoreFile(2022, 12, "parquet", f"{_ROOT}/2022/csv/core202212.parquet"),
    CoreFile(2023, 5, "csv", f"{_ROOT}/2023/5/core_20235.csv"),
    CoreFile(2024, 12, "parquet", f"{_ROOT}/2024/12/core_202412.parquet"),
    CoreFile(2025, 12, "parquet", f"{_ROOT}/2025/12/core_202512.parquet"),
)
#: The taxonomy files that have provider ids, newest first.
TAXONOMY_FILES = {
    "2025-12": f"{_ROOT}/2025/12/byvar/PTAXCODE_202512.parquet",
    "2024-12": f"{_ROOT}/2024/12/byvar/PTAXCODE_202412.parquet",
    "2023-05": f"{_ROOT}/2023/5/ptaxcode_20235.csv",
    "2019-12": f"{_ROOT}/2019/12/byvar/PTAXCODE_201912.parquet",
}


def core_file(year: int) -> CoreFile:
    found = [f for f in CORE_FILES if f.year == year]
    if len(found) != 1:
        raise LookupError(f"no core file is listed for {year}; listed are {[f.year for f in CORE_FILES]}")
    return found[0]


def taxonomy_vintage(path: str) -> str | None:
    """The vintage of a taxonomy file by its name; None for a file that is not listed."""
    names = {url.rsplit("/", 1)[1]: vintage for vintage, url in TAXONOMY_FILES.items()}
    return names.get(path.rstrip("/").rsplit("/", 1)[-1])


def fetch(url: str, folder: str, timeout: float = 3600) -> str:
    """The file's local path; a file that is there is left alone, a broken transfer leaves none."""
    target = Path(folder) / url.rsplit("/", 1)[1]
    if target.exists():
        return str(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    partial = target.with_name(target.name + ".part")
    with urllib.request.urlopen(url, timeout=timeout) as source, partial.open("wb") as out:  # noqa: S310
        while block := source.read(1 << 20):
            out.write(block)
    if not partial.stat().st_size:
        raise OSError(f"{url} is empty")
    partial.rename(target)
    return str(target)


def fetch_core(year: int, folder: str, timeout: float = 3600) -> str:
    return fetch(core_file(year).url, folder, timeout)


def fetch_taxonomy(folder: str, timeout: float = 3600) -> list[str]:
    return [fetch(url, folder, timeout) for url in TAXONOMY_FILES.values()]
