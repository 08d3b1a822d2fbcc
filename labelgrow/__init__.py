"""DataFrame jobs that grow a labelled set out of a large, mostly unlabelled one."""
