"""Sources: file scans (delimited, JSON, XML, DBF, workbook), tables, JDBC, SQL."""
