"""End-to-end plans: import (files -> table), export (table/query -> files)."""
