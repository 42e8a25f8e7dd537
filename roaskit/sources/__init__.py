"""Reading and writing: channel exports, the fact view, state tables, run history."""
