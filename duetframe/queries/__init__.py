"""The registered queries of the experiment side, with the SQL that checks them."""
