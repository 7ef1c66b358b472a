"""The analytical reports, each one lazy DataFrame over all tenants."""
