"""Tables, snapshots, delete-vector tables, codecs and the shared folder."""
