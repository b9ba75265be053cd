"""Every operator as a query over the test tables, with the same result stated in SQL."""
