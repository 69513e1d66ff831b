"""Set-oriented operators over captured pages, URLs and scans."""
