"""Sources of panels."""

from panelwright.sources.series import fill_calendar, from_table, panel_from_facts, read_series
from panelwright.sources.store import read_panel, write_panel

__all__ = ["fill_calendar", "from_table", "panel_from_facts", "read_panel", "read_series", "write_panel"]
