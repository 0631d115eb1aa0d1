"""Files that a vault begins with: view files, weekly logs; its context note, and its year of points as a grid."""

from __future__ import annotations

import calendar
import datetime
import posixpath

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VIEWS = {
    "Tickets.base": ("ticket", {"Open": 'status == "open"', "Backlog": "!status.isTruthy()", "Done": 'status == "done"'}, ["file.name", "status", "kind", "track", "created"]),
    "Tracks.base": ("track", {"Active": 'status == "active"', "Paused": 'status == "paused"'}, ["file.name", "status", "description", "updated"]),
}
LEVEL = 50


class StarterError(ValueError):
    """A file that can't be made, or is there already."""


def _system(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root.rstrip("/"))


def _exists(system: pafs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type == pafs.FileType.File


def _read(system: pafs.FileSystem, path: str) -> str:
    with system.open_input_stream(path) as file:
        return file.read().decode("utf-8")


def _write(system: pafs.FileSystem, path: str, content: str) -> None:
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(path) as file:
        file.write(content.encode("utf-8"))


def view_file(name: str, folder: str) -> str:
    """A view file for the notes of a kind in a project's folder."""
    kind, views, order = VIEWS[name]
    lines = ["filters:", "  and:", f'    - type == "{kind}"', f'    - file.inFolder("{folder}")', "views:"]
    for view, condition in views.items():
        quoted = "'" + condition.replace("'", "''") + "'"
        lines += [f"  - name: {view}", "    filters:", "      and:", f"        - {quoted}", f"    order: [{', '.join(order)}]", "    sort:", "      - property: file.name", "        direction: ASC"]
    return "\n".join(lines) + "\n"


def init_views(root: str, folder: str, name: str) -> str:
    """Writes a project's view file and returns its path; one that is there is never overwritten."""
    system, base = _system(root)
    path = posixpath.join(base, folder, name)
    if _exists(system, path):
        raise StarterError(f"{path} is there already")
    _write(system, path, view_file(name, folder))
    return path


def week_of(day: datetime.date) -> tuple[str, datetime.date, datetime.date]:
    """The ISO week of a day, its Monday and its Sunday."""
    year, week, weekday = day.isocalendar()
    monday = day - datetime.timedelta(days=weekday - 1)
    return f"{year}-W{week:02d}", monday, monday + datetime.timedelta(days=6)


def week_log(root: str, folder: str, day: datetime.date, today: datetime.date, template: str = "templates/Weekly Log.md") -> str:
    """The path of a week's log; one of this week or a later one is made from the template if it isn't there."""
    system, base = _system(root)
    week, monday, sunday = week_of(day)
    path = posixpath.join(base, folder, f"{week.lower()}.md")
    if _exists(system, path):
        return path
    if sunday < today:
        raise StarterError(f"{week} has no log, and it ended on {sunday}")
    if not _exists(system, source := posixpath.join(base, template)):
        raise StarterError(f"no template at {source}")
    values = {"week:": week, "start:": monday, "end:": sunday}
    # Only fields without a value are filled.
    lines = [f"{line.strip()} {values[line.strip()]}" if not line.startswith(" ") and line.strip() in values else line for line in _read(system, source).splitlines()]
    _write(system, path, "\n".join(lines) + "\n")
    return path


def context(root: str, folder: str = "") -> str:
    """The context note of a project, or of the vault."""
    system, base = _system(root)
    for name in ("Context.md", "context.md"):
        if _exists(system, path := posixpath.join(base, folder, name)):
            return _read(system, path)
    raise StarterError(f"no context note in {posixpath.join(base, folder)}")


#: Steps of the grid's colours: dark and light backgrounds, from no points to many.
SHADES = {True: (236, 22, 28, 34, 40, 46), False: (254, 194, 157, 120, 83, 28)}
STEPS = (1, 3, 6, 10, 15)


def calendar_grid(days: DataFrame, year: int, streak: int, today: datetime.date, dark: bool = True) -> str:
    """A year's points, a row a weekday and a column a week, with the streak, the level and the sum below.

    ``days`` has (day, xp); a year's rows, 366 at most, come to the driver.  Days after today are left blank, today is
    marked.
    """
    rows = days.where(F.col("day").between(f"{year}-01-01", f"{year}-12-31")).select("day", "xp").limit(366).collect()
    xp = {datetime.date.fromisoformat(r.day): int(r.xp) for r in rows}
    first = datetime.date(year, 1, 1)
    begin = first - datetime.timedelta(days=first.weekday())
    weeks = (datetime.date(year, 12, 31) - begin).days // 7 + 1
    heads, place = [" "] * (2 * weeks + 4), 0
    for month in range(1, 13):
        at = (datetime.date(year, month, 1) - begin).days // 7 * 2 + 4
        if at >= place:
            heads[at : at + 3] = calendar.month_abbr[month]
            place = at + 4
    out = ["".join(heads).rstrip()]
    for weekday in range(7):
        cells = []
        for week in range(weeks):
            day = begin + datetime.timedelta(days=7 * week + weekday)
            if day.year != year or day > today:
                cells.append("  ")
                continue
            shade = SHADES[dark][sum(xp.get(day, 0) >= s for s in STEPS)]
            cells.append(f"\x1b[48;5;{shade}m{'()' if day == today else '  '}\x1b[0m")
        out.append(f"{calendar.day_abbr[weekday]} {''.join(cells)}".rstrip())
    total = sum(v for d, v in xp.items() if d <= today)
    # Division drops the rest towards zero, also below it.
    return "\n".join([*out, "", f"streak {streak} · level {int(total / LEVEL)} · {total} points"]) + "\n"
